"""Writers: merges, group replacement, price sync, control rows, models; and the options of a Kafka read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterflow.operators import merge, upsert
from meterflow.plans import forecast, learning
from meterflow.sources import readers, sinks
from meterflow.streaming import microbatch

KEYS = ["k"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, dt string")


def table(spark, path):
    return sorted((r["k"], r["v"], str(r["dt"])) for r in spark.read.parquet(path).collect())


def test_merge_takes_one_row_a_key_and_moves_it(spark, tmp_path):
    path, staging = f"{tmp_path}/t", f"{tmp_path}/s"
    add = lambda rows: merge.merge_into(spark, path, frame(spark, rows), KEYS, ["dt"], staging)
    add([(1, "a", "d1"), (1, "a", "d1"), (2, "b", "d1"), (3, "c", "d2")])
    assert table(spark, path) == [(1, "a", "d1"), (2, "b", "d1"), (3, "c", "d2")]
    add([(2, "n", "d1"), (2, "n", "d1"), (4, "x", "d3")])
    assert table(spark, path) == [(1, "a", "d1"), (2, "n", "d1"), (3, "c", "d2"), (4, "x", "d3")]
    add([(3, "moved", "d1")])  # its old partition ends up empty
    assert table(spark, path) == [(1, "a", "d1"), (2, "n", "d1"), (3, "moved", "d1"), (4, "x", "d3")]


def test_groups_are_replaced_in_every_partition(spark, tmp_path):
    path, staging = f"{tmp_path}/t", f"{tmp_path}/s"
    frame(spark, [(1, "a", "d1"), (1, "a", "d2"), (2, "b", "d2"), (2, "b", "d3")]).write.partitionBy("dt").parquet(path)
    merge.replace_groups_into(spark, path, frame(spark, [(1, "n", "d3"), (1, "n", "d4")]), KEYS, ["dt"], staging)
    assert table(spark, path) == [(1, "n", "d3"), (1, "n", "d4"), (2, "b", "d2"), (2, "b", "d3")]
    merge.replace_groups_into(spark, path, frame(spark, []), KEYS, ["dt"], staging)
    assert len(table(spark, path)) == 4


def test_price_sync_writes_months_once(spark, tmp_path):
    schema = "id long, price double, updated_at string"
    sync = lambda rows, kind: sinks.write_price_sync(spark.createDataFrame(rows, schema), f"{tmp_path}/p", kind)
    sync([(1, 1.0, "2024-01-05 00:00:00"), (2, 2.0, "2024-02-05 00:00:00")], "incremental")
    sync([(2, 2.0, "2024-02-05 00:00:00"), (2, 3.0, "2024-02-06 00:00:00"), (2, 3.0, "2024-02-06 00:00:00")], "incremental")
    out = spark.read.parquet(f"{tmp_path}/p")
    assert sorted((r["id"], r["price"], str(r["ym"])) for r in out.collect()) == [(1, 1.0, "202401"), (2, 2.0, "202402"), (2, 3.0, "202402")]
    sync([(9, 9.0, "2024-03-01 00:00:00")], "full")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1


def test_price_snapshot_reads_numbers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": 1, "price": "0.8", "price_type": "gas"}\n{"id": 2, "price": "none"}\n')
    out = {r["id"]: (r["price"], r["source"]) for r in readers.price_snapshot(spark, f"{tmp_path}/p.json").collect()}
    assert out == {1: (0.8, "snapshot"), 2: (None, "snapshot")}


def test_kafka_options():
    made = readers.kafka_options("h:9092", most=100)
    assert made == {"kafka.bootstrap.servers": "h:9092", "subscribePattern": "sensor_.*", "startingOffsets": "latest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "100"}
    bounded = readers.kafka_options("h:9092", starting="earliest", ending="latest")
    assert bounded["endingOffsets"] == "latest" and "maxOffsetsPerTrigger" not in bounded
    with pytest.raises(ValueError):
        readers.kafka_options("h:9092", starting="sometimes")


def test_control_rows(spark, tmp_path):
    lake = sinks.Lake(str(tmp_path))
    schema = "job_name string, processed_rows long"
    assert sinks.read_control(spark, lake, "control", schema).count() == 0
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "event_time timestamp, ingest_time timestamp")
    row = microbatch.mark_current(events, "job", "from", "to")
    sinks.write_control(row, lake, "control")
    assert sinks.read_control(spark, lake, "control", schema).first()["processed_rows"] == 0
    bounds = events.select(*[c.alias(n) for c, n in zip(microbatch.window_bounds("event_time", "ingest_time", "day"), "ab")]).first()
    assert (bounds["a"].day, bounds["b"].day) == (1, 3)


@pytest.fixture(scope="module")
def known(spark):
    """A target that one feature decides, differently for each unit."""
    start = dt.datetime(2024, 1, 1)
    rows = [(u, start + dt.timedelta(hours=i), float(i % 7), float(i % 7) * (10 if u == "a" else -3) + 30) for u in ("a", "b") for i in range(200)]
    rows += [("c", start, 1.0, 1.0)]  # too few rows
    return spark.createDataFrame(rows, "unit string, at timestamp, x double, y double")


def test_models_learn_a_known_function(spark, known, tmp_path):
    for kind, changes, least in (("forest", {}, 0.6), ("boosted", {"maxIter": 20}, 0.95)):  # a forest's node sees one of the two features
        model, found = learning.train_and_evaluate(known, ["x"], "y", ["unit"], "at", kind, **changes)
        assert {r["unit"]: r["r2"] > least for r in found.collect()} == {"a": True, "b": True}
    learning.save(model, f"{tmp_path}/m")
    again, rows = learning.load(f"{tmp_path}/m"), known.filter("unit <> 'c'")
    assert learning.predict(again, rows).collect() == learning.predict(model, rows).collect()
    assert '"feature":"x"' in learning.importances(model, ["x"], spark).first()["top_features"]


def test_each_unit_has_its_own_model(known):
    models, found = learning.train_each(known, ["x"], "y", "unit", "at")
    assert set(models) == {"a", "b"} and {r["unit"]: r["r2"] > 0.6 for r in found.collect()} == {"a": True, "b": True}


def test_training_rows_are_prepared(spark):
    rows = [("a", 1, 1.0, 5.0), ("a", 2, None, 6.0), ("a", 3, 3.0, None)]
    out, names = forecast.prepare_training(spark.createDataFrame(rows, "unit string, at int, x double, y double"), "y", ["at"], ["unit"], "at")
    assert names == ["x"] and [tuple(r) for r in out.orderBy("at").select("at", "x", "y").collect()] == [(1, 1.0, 5.0), (2, 1.0, 6.0)]


def rows_of(spark, path):
    schema = "k long, v string, dt string"
    return sorted((tuple(r) for r in spark.read.schema(schema).parquet(path).collect()), key=str)


def test_merge_keeps_rows_of_a_null_partition(spark, tmp_path):
    path, staging = f"{tmp_path}/t", f"{tmp_path}/s"
    add = lambda rows: merge.merge_into(spark, path, frame(spark, rows), KEYS, ["dt"], staging)
    add([(1, "a", None), (3, "c", None), (2, "b", "x")])
    add([(9, "i", None), (10, "j", "")])  # an empty text is stored as NULL
    assert rows_of(spark, path) == [(1, "a", None), (10, "j", None), (2, "b", "x"), (3, "c", None), (9, "i", None)]


def test_merge_moves_a_key_from_an_escaped_partition(spark, tmp_path):
    path, staging = f"{tmp_path}/t", f"{tmp_path}/s"
    add = lambda rows: merge.merge_into(spark, path, frame(spark, rows), KEYS, ["dt"], staging)
    add([(1, "a", "x/y z:1"), (2, "b", None), (3, "c", "007")])
    add([(1, "n", "q"), (2, "n", "q")])
    add([(3, "n", "7")])  # 007 is a text, not the number
    assert rows_of(spark, path) == [(1, "n", "q"), (2, "n", "q"), (3, "n", "7")]


def test_null_keys_are_added_once(spark, tmp_path):
    rows = frame(spark, [(None, "a", "d"), (1, "b", "d")])
    assert upsert.insert_only(rows, rows, KEYS).count() == 2
    for _ in range(2):
        merge.merge_into(spark, f"{tmp_path}/t", rows, KEYS, ["dt"], f"{tmp_path}/s", upsert.insert_only)
    assert rows_of(spark, f"{tmp_path}/t") == [(1, "b", "d"), (None, "a", "d")]
    prices = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "2024-01-01")], "id long, price double, updated_at string")
    for _ in range(3):
        sinks.write_price_sync(prices, f"{tmp_path}/p", "incremental")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_a_stopped_merge_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path, staging = f"{tmp_path}/t", f"{tmp_path}/s"
    add = lambda rows: merge.merge_into(spark, path, frame(spark, rows), KEYS, ["dt"], staging)
    add([(i, "a", f"d{i}") for i in range(6)])
    for stop in (0, 2, 4):  # at an early, a middle and a late move
        moved, real = [], merge._move

        def move(table, source, target):
            if len(moved) == stop:
                raise KeyboardInterrupt
            moved.append(source)
            real(table, source, target)

        monkeypatch.setattr(merge, "_move", move)
        with pytest.raises(KeyboardInterrupt):
            add([(0, f"v{stop}", "d0"), (1, f"v{stop}", "d1"), (2, f"v{stop}", "d9")])
        monkeypatch.setattr(merge, "_move", real)
        add([(7, "z", "d7")])
        want = [(0, f"v{stop}", "d0"), (1, f"v{stop}", "d1"), (2, f"v{stop}", "d9"), (3, "a", "d3"), (4, "a", "d4"), (5, "a", "d5"), (7, "z", "d7")]
        assert rows_of(spark, path) == want


def test_a_merge_into_many_partitions_reads_those_it_must(spark, tmp_path, monkeypatch):
    path, staging = f"{tmp_path}/t", f"{tmp_path}/s"
    rows = spark.range(5_000).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.concat(F.lit("d"), (F.col("id") % 1000).cast("string")).alias("dt"))
    rows.repartition(4, "dt").write.partitionBy("dt").parquet(path)
    read, real = [], merge.Stored.read
    monkeypatch.setattr(merge.Stored, "read", lambda self, partitions, columns=None: read.append((len(partitions), columns)) or real(self, partitions, columns))
    one = frame(spark, [(77, "n", "new")])
    table = merge.Stored(spark, path, ["dt"], one).refresh()
    assert len(table.dirs) == 1000
    merge.summarise(table, list(table.dirs), KEYS)
    read.clear()
    merge.merge_into(spark, path, one, KEYS, ["dt"], staging)
    searched = [n for n, columns in read if columns]
    rewritten = [n for n, columns in read if not columns]
    assert searched[0] <= 3 and max(rewritten) == 2  # the filters leave the key's partition and hardly another
    out = rows_of(spark, path)
    assert len(out) == 5_000 and [r for r in out if r[0] == 77] == [(77, "n", "new")]
    read.clear()
    merge.merge_into(spark, path, frame(spark, [(77, "m", "new")]), ["k", "dt"], ["dt"], staging)
    assert [n for n, columns in read if columns] == [] and read[0][0] == 1  # the partition is part of the key: no search
    changed = next(v for v in table.dirs if v != ("new",))
    merge.write_partitions(frame(spark, [(123_456, "w", changed[0])]), path, ["dt"])  # written past the summaries
    merge.merge_into(spark, path, frame(spark, [(123_456, "n", "new")]), KEYS, ["dt"], staging)
    assert [r for r in rows_of(spark, path) if r[0] == 123_456] == [(123_456, "n", "new")]


def test_a_grain_that_has_no_rows_any_more_goes(spark, tmp_path):
    path, staging = f"{tmp_path}/t", f"{tmp_path}/s"
    frame(spark, [(1, "a", "d1"), (1, "b", "d1"), (2, "c", "d1"), (3, "d", "d2")]).write.partitionBy("dt").parquet(path)
    merge.replace_grains_into(spark, path, frame(spark, [(1, "n", "d1")]), frame(spark, [(1, "", "d1"), (3, "", "d2")]).select("k", "dt"), ["dt"], staging)
    assert rows_of(spark, path) == [(1, "n", "d1"), (2, "c", "d1")]
