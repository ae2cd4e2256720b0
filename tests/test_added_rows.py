"""A merge that only inserts costs what its rows cost, not what the partitions' rows do; a batch looks meters' hours up once a day."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterflow.operators import merge, upsert
from meterflow.sources.sinks import Lake
from meterflow.streaming.propagate import Chain


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, dt string").coalesce(1)


def names(path):
    return {str(x.relative_to(path)) for x in path.rglob("*.parquet")}


def table(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(str(path)).select("k", "v", "dt").collect())


def test_inserts_leave_the_files_that_are_there(spark, tmp_path, monkeypatch):
    path, staging = tmp_path / "t", f"{tmp_path}/s"
    add = lambda rows: merge.merge_into(spark, str(path), frame(spark, rows), ["dt", "k"], ["dt"], staging, upsert.insert_only)
    add([(1, "a", "d1"), (2, "b", "d2"), (None, "n", "d1")])
    old = names(path)
    more, rows = [(1, "again", "d1"), (3, "c", "d1"), (3, "c", "d1"), (None, "again", "d1"), (4, "d", "d3")], [(1, "a", "d1"), (2, "b", "d2"), (3, "c", "d1"), (4, "d", "d3"), (None, "n", "d1")]
    key = lambda r: (r[0] is None, r)
    read = lambda: sorted((tuple(r) for r in spark.read.parquet(str(path)).select("k", "v", "dt").collect()), key=key)
    move, left = merge._move, [1]

    def stops(*args):
        if not left:
            raise KeyboardInterrupt
        left.pop()
        move(*args)

    monkeypatch.setattr(merge, "_move", stops)
    with pytest.raises(KeyboardInterrupt):  # after the first of two files has moved
        add(more)
    monkeypatch.setattr(merge, "_move", move)
    for _ in range(2):  # what had been staged moves in, then nothing is new
        add(more)
        assert read() == rows and old < names(path) and len(names(path)) == len(old) + 2
    monkeypatch.setattr(merge, "MANY_FILES", 2)  # d1 has two small files: it is written anew
    add([(5, "e", "d1")])
    assert read() == sorted([*rows, (5, "e", "d1")], key=key) and not {n for n in old & names(path) if n.startswith("dt=d1")}


def test_other_columns_are_merged_as_before(spark, tmp_path):
    path, staging = tmp_path / "t", f"{tmp_path}/s"
    merge.merge_into(spark, str(path), frame(spark, [(1, "a", "d1")]), ["dt", "k"], ["dt"], staging)
    merge.merge_into(spark, str(path), frame(spark, [(2, "b", "d1")]).drop("v"), ["dt", "k"], ["dt"], staging, upsert.insert_only)
    assert table(spark, path) == [(1, "a", "d1"), (2, None, "d1")]


def test_a_batch_reads_a_day_of_the_fact_four_times(spark, tmp_path, monkeypatch):
    schema = "station_id string, point_code string, point_name string, system_type string, equipment_id string, theme string, measure_role string, event_time timestamp, value double, source_topic string, partition_id int, offset_id bigint, dt date"
    at = lambda hour: dt.datetime(2024, 3, 1, hour, 5)
    row = lambda hour, i: ("s", "P9_ADDH", "p", "cchp", "P9_ADDH", "cumulative", None, at(hour), float(hour), "t", 0, i, at(hour).date())
    chain, read, real = Chain(spark, Lake(str(tmp_path)), periods=()), [], Chain.read
    chiller = ("s", "L1_F", "f", "chiller", "chiller_1", "flow", "flow", at(1), 5.0, "t", 0, 9, at(1).date())
    chain.add(spark.createDataFrame([row(1, 1), row(3, 3), chiller], schema))
    monkeypatch.setattr(Chain, "read", lambda self, table, days: read.append((table, len(days))) or real(self, table, days))
    chain.add(spark.createDataFrame([row(2, 2)], schema))
    assert read.count(("fact", 1)) == 4  # minutes, meters' hours, hours' own readings, meters' last ones
    got = chain.lake.read(spark, "hours").filter("system_type = 'cchp'").orderBy("stat_hour").select(F.hour("stat_hour"), "cooling_supply_kwh").collect()
    assert [tuple(r) for r in got] == [(1, 0.0), (2, 1.0), (3, 1.0)]
