"""The stream's advances of meters are the batch's: over resets, gaps, late rows and restarts; windows in chunks are the plain ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterflow.operators import chunks, joins, windows
from meterflow.streaming import advances

START = dt.datetime(2024, 1, 1)
SCHEMA = "station_id string, point_code string, event_time timestamp, value double"


def test_the_streams_advances_are_the_batchs(spark, tmp_path):
    rng, files = random.Random(1), []
    for day in range(3):
        rows = []
        for i in range(150):
            at = START + dt.timedelta(days=day, minutes=rng.randrange(day and -100, 1440))  # some are late, within the lateness
            meter = rng.choice("abc")
            grows = (at - START).total_seconds() / 60
            value = None if rng.random() < 0.15 else grows % 1700 if meter == "a" else grows * 40 if meter == "b" else grows
            if meter == "c" and at.hour in (3, 4, 5, 6):
                continue  # hours without a row
            rows.append(("s", meter, at, value))
        files.append(rows)
    files.append([("s", "z", START + dt.timedelta(days=9), 1.0)])  # moves the watermark past all hours
    too_late = [("s", "a", START + dt.timedelta(hours=1), 9e9)]
    files.append(too_late + [("s", "z", START + dt.timedelta(days=9, hours=5), 1.0)])
    before = spark.conf.get(advances.STATE_STORE[0])
    spark.conf.set(*advances.STATE_STORE)
    try:
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            made = advances.meter_advances(stream, ["station_id", "point_code"], "event_time", "value", 1500, "2 hours")
            query = made.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet")
            query.awaitTermination()  # each file is a run of its own, which goes on from the stored state
    finally:
        spark.conf.set(advances.STATE_STORE[0], before)
    on_time = spark.createDataFrame([r for f in files[:3] for r in f], SCHEMA).withColumn("stat_hour", F.date_trunc("hour", "event_time"))
    batch = windows.counter_delta(on_time, ["station_id", "point_code"], "stat_hour", "value", 1500)
    get = lambda df: sorted(str(tuple(r)) for r in df.filter("point_code <> 'z'").select("point_code", "stat_hour", F.round("reading", 6), F.round("delta", 6)).collect())
    expected = get(batch)
    assert get(spark.read.parquet(f"{tmp_path}/out")) == expected
    assert any("None" in r for r in expected) and sum("None" not in r for r in expected) > 60


@pytest.fixture(scope="module")
def sparse(spark):
    """Series with full, thin and missing months, and NULLs over whole months."""
    rng, rows = random.Random(2), []
    for unit, chance in (("full", 0.9), ("thin", 0.02), ("one", 0)):
        for h in range(0, 24 * 200, 3):
            if rng.random() < chance:
                at = START + dt.timedelta(hours=h)
                rows.append((unit, at, None if at.month in (2, 3) or rng.random() < 0.3 else rng.choice([float("nan"), float("inf"), rng.random(), rng.random()])))
    rows += [("one", START, 5.0), ("null", START, None), ("null", START + dt.timedelta(days=90), None)]
    return spark.createDataFrame(rows, "unit string, at timestamp, v double")


@pytest.mark.parametrize("n,unit", [(1, "month"), (7, "week"), (30, "month"), (30, "day")])
def test_windows_in_chunks_are_the_plain_ones(sparse, n, unit):
    def apply(rows, keys):
        return windows.trailing(windows.lags(rows, keys, ["at"], "v", (1, n)), keys, ["at"], "v", (n,), ("max", "min"))

    get = lambda df: sorted(map(str, df.collect()))
    columns = ["unit", "at", "v", "lag_1", f"lag_{n}", f"max_{n}", f"min_{n}"] if n > 1 else ["unit", "at", "v", "lag_1", "max_1", "min_1"]
    assert get(chunks.in_chunks(sparse, ["unit"], ["at"], n, apply, unit).select(*columns)) == get(apply(sparse, ["unit"]).select(*columns))


def test_values_and_meters_in_chunks(sparse):
    get = lambda df: sorted(map(str, df.collect()))
    for unit in ("month", "day"):
        assert get(chunks.clean_series(sparse, ["unit"], ["at"], ["v"], unit)) == get(windows.clean_series(sparse, ["unit"], ["at"], ["v"]))
    finite = sparse.filter("NOT isnan(v) AND v < 10 OR v IS NULL")
    assert get(chunks.counter_delta(finite, ["unit"], "at", "v", 0.5)) == get(windows.counter_delta(finite, ["unit"], "at", "v", 0.5))
    assert chunks.in_chunks(sparse.limit(0), ["unit"], ["at"], 3, lambda rows, keys: windows.lags(rows, keys, ["at"], "v", (3,))).count() == 0


def test_a_task_holds_one_chunk_and_the_rows_it_needs(sparse):
    rows = chunks.with_rows_before(sparse, ["unit"], ["at"], 5)
    sizes = rows.groupBy("unit", chunks.CHUNK).agg(F.count_if(chunks.CARRIED).alias("carried"), F.count_if(~F.col(chunks.CARRIED)).alias("own"))
    assert all(r["carried"] <= 5 for r in sizes.collect())
    assert sizes.agg(F.sum("own")).first()[0] == sparse.count()


def test_offsets_take_one_exchange(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    history = spark.createDataFrame([("u", at(h), float(h)) for h in (0, 1, 3, 24)], "unit string, at timestamp, v double")
    ahead = spark.createDataFrame([("u", at(h), "x") for h in (1, 2, 25, 48)] + [("w", at(1), "y")], "unit string, at timestamp, v string")
    out = joins.at_offset(ahead, history, ["unit"], "at", "v", (1, 24))
    assert sorted((r["unit"], r["at"].day * 24 + r["at"].hour - 24, r["v"], r["at_1"], r["at_24"]) for r in out.collect()) == [
        ("u", 1, "x", 0.0, None), ("u", 2, "x", 1.0, None), ("u", 25, "x", 24.0, 1.0), ("u", 48, "x", None, 24.0), ("w", 1, "y", None, None),
    ]
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ") == 1
