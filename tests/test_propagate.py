"""Late readings brought through a stored lake give what a full rebuild gives; stopped jobs go on where they were."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterflow.catalog.builds import POINTS
from meterflow.plans import reports
from meterflow.sources.sinks import Lake
from meterflow.streaming import microbatch
from meterflow.streaming.ledger import Ledger
from meterflow.streaming.propagate import PARTITIONS, Chain, period_days, propagating_stream

START = dt.datetime(2024, 1, 28)  # a Sunday: days on both sides of a week's and a month's end
FACT = "station_id string, point_code string, point_name string, system_type string, equipment_id string, theme string, measure_role string, event_time timestamp, value double, source_topic string, partition_id int, offset_id bigint, dt date"
GOLD = ["minutes", "hours", "day", "week", "month"]


def readings(seed, n=900):
    """Readings of two stations over eight days; meters grow, reset and pause for days; some values are missing."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        code, name, system, unit, theme, role = rng.choice(POINTS)
        at = START + dt.timedelta(minutes=rng.randrange(8 * 24 * 60))
        if code == "P9_ADDH":
            at = START + dt.timedelta(days=rng.choice([0, 1, 5, 7]), minutes=rng.randrange(1440))  # days without a reading
        grows = (at - START).total_seconds() / 60 % 7000 + rng.random()
        value = None if rng.random() < 0.1 else grows * (300 if code == "FT2005_RL_C" else 1) if theme == "cumulative" or "GAS_TOTAL" in code else rng.choice([0.0, 1.0]) if theme == "status" else rng.uniform(1, 60)
        rows.append((f"station_{rng.randrange(2)}", code, name, system, unit, theme, role, at, value, "t", seed, i, at.date()))
    return rows


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """(chain after two batches, chain rebuilt from the same fact)."""
    rows = readings(1)
    rng = random.Random(2)
    rng.shuffle(rows)
    some = [r for r in rows if r[7] < START + dt.timedelta(days=6)]
    first, second = some[:-12] + [r for r in rows if r not in some], some[-12:]
    out = []
    for name, batches in (("steps", [first, second, second]), ("whole", [first + second])):
        chain = Chain(spark, Lake(str(tmp_path_factory.mktemp(name))))
        for batch in batches:
            chain.add(spark.createDataFrame(batch, FACT))
        out.append(chain)
    return out


def shown(chain, table):
    rows = chain.lake.read(chain.spark, table).drop("created_at", "updated_at")
    texts = [F.coalesce((F.round(c, 6) if t == "double" else F.col(c)).cast("string"), F.lit("-")) for c, t in sorted(rows.dtypes)]
    return sorted(r[0] for r in rows.select(F.concat_ws("|", *texts)).collect())


def test_late_readings_equal_a_rebuild(late):
    steps, whole = late
    assert steps.lake.read(steps.spark, "fact").count() == 900
    for table in GOLD:
        assert shown(steps, table) == shown(whole, table) != [], table


def test_a_rebuild_from_the_fact_equals_the_plans(late):
    spark, chain = late[1].spark, late[1]
    fact = chain.lake.read(spark, "fact")
    direct = chain.hours(chain.minutes(fact), fact)
    stored = chain.lake.read(spark, "hours").select(*direct.columns)
    get = lambda df: sorted(map(str, df.drop("created_at", "updated_at").withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"}).collect()))
    assert get(direct) == get(stored)
    for period in ("day", "week", "month"):
        assert reports.system_report(direct, period).count() == len(shown(chain, period))


def test_the_interval_fallback_equals_the_batch(spark, tmp_path, late):
    rows = readings(1)
    chain = Chain(spark, Lake(str(tmp_path)))
    microbatch.upsert_lineage(spark, spark.createDataFrame(rows, FACT), chain.lake.path("fact"), chain.staging("fact"))
    chain.propagate_interval(START, START + dt.timedelta(days=8))
    for table in ("hours", "week"):
        assert shown(chain, table) == shown(late[1], table)


def test_a_step_reads_the_days_it_needs(spark, late, monkeypatch):
    chain, read, real = late[0], [], Chain.read
    monkeypatch.setattr(Chain, "read", lambda self, table, days: read.append((table, list(days))) or real(self, table, days))
    day = (START + dt.timedelta(days=3)).date()
    at = START + dt.timedelta(days=3, hours=5, minutes=7)
    row = ("station_0", "L1_F", "1#站1#冷机流量", "chiller", "chiller_1", "flow", "flow", at, 12.5, "t", 9, 1, day)  # no meter
    before = {t: {v: m for v, m in _marks(chain, t).items()} for t in ("fact", "minutes", "hours", "day")}
    chain.add(spark.createDataFrame([row], FACT))
    assert [d for t, d in read if t == "minutes"] == [[day]] and read[0] == ("fact", [day])
    for table, old in before.items():  # the other days' files are the same
        now = _marks(chain, table)
        assert {v for v in now if now[v] != old.get(v)} == {(str(day),)}
    plan = chain.read("fact", [day])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(dt" in plan or "PartitionFilters: [(dt" in plan or f"= {day}" in plan  # noqa: F541


def _marks(chain, table):
    from meterflow.operators import merge

    like = chain.spark.createDataFrame([], f"{PARTITIONS[table]} date")
    return merge.Stored(chain.spark, chain.lake.path(table), [PARTITIONS[table]], like).refresh().marks


def test_a_killed_stream_takes_its_batch_again(spark, tmp_path):
    rows = [(f"{c[0]}", START + dt.timedelta(minutes=7 * i), float(i), "t", 0, i) for i, c in enumerate(POINTS)]
    messages = "sensor_id string, timestamp timestamp, value double, source_topic string, partition_id int, offset_id bigint"
    spark.createDataFrame(rows, messages).coalesce(1).write.parquet(f"{tmp_path}/bronze")
    points = spark.createDataFrame([(p[0], p[1], "station_1", p[2], p[3], p[4], None, p[5]) for p in POINTS], "point_code string, point_name string, station_id string, system_type string, equipment_id string, theme string, unit string, measure_role string")
    chain, ledger = Chain(spark, Lake(f"{tmp_path}/lake"), periods=()), Ledger(spark, f"{tmp_path}/ledger", "stream")
    start = lambda: propagating_stream(spark.readStream.schema(messages).parquet(f"{tmp_path}/bronze"), points, chain, ledger, f"{tmp_path}/check")
    enter = Ledger.enter
    try:
        Ledger.enter = lambda *a, **k: 1 / 0  # the tables are written, the entry is not
        with pytest.raises(Exception, match="ZeroDivision|division"):
            start().awaitTermination()
    finally:
        Ledger.enter = enter
    for _ in range(2):
        start().awaitTermination()
    assert chain.lake.read(spark, "fact").count() == len(POINTS)
    assert [(r["batch"], r["processed_rows"]) for r in ledger.entries().collect()] == [(0, len(POINTS))]


def test_days_of_periods():
    day = dt.date(2024, 2, 29)
    assert period_days(day, "day") == [day] and len(period_days(day, "month")) == 29
    assert [period_days(day, "week")[i].isoformat() for i in (0, 6)] == ["2024-02-26", "2024-03-03"]


def test_a_stopped_job_goes_on_without_loss_or_repeat(spark, tmp_path):
    bronze, target, ledger = f"{tmp_path}/bronze", f"{tmp_path}/target", Ledger(spark, f"{tmp_path}/ledger", "job")
    t0 = dt.datetime(2024, 1, 1)

    def arrive(*n):
        spark.createDataFrame([(i, t0 + dt.timedelta(hours=i)) for i in n], "k bigint, ingest_time timestamp").write.mode("append").parquet(bronze)

    def work(rows, stop=False):
        from meterflow.operators import merge, upsert

        rows = rows.withColumn("dt", F.to_date("ingest_time"))
        merge.merge_into(spark, target, rows, ["dt", "k"], ["dt"], f"{target}_staging", upsert.insert_only)
        seen.append(sorted(r["k"] for r in rows.collect()))
        if stop:
            raise KeyboardInterrupt
        return rows.count()

    seen = []
    arrive(1, 2, 3)
    ledger.cut_over(spark.read.parquet(bronze).filter("k = 1"))
    with pytest.raises(KeyboardInterrupt):  # between the write and the mark
        ledger.advance(spark.read.parquet(bronze), lambda rows: work(rows, True))
    arrive(4, 5)
    assert ledger.advance(spark.read.parquet(bronze), work) == 1
    assert ledger.advance(spark.read.parquet(bronze), work) == 2
    assert ledger.advance(spark.read.parquet(bronze), work) is None
    assert seen == [[2, 3], [2, 3], [4, 5]]
    assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == [2, 3, 4, 5]
    assert ledger.once(9, lambda: 1) and not ledger.once(9, lambda: 1 / 0)
    assert [r["processed_rows"] for r in ledger.entries().filter("state = 'done'").orderBy("batch").collect()] == [0, 2, 2, 1]
    assert Ledger(spark, f"{tmp_path}/ledger", "other").last() is None
