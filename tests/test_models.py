"""Models by unit: one pass over the source, a registry of versions, and the three modes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterflow.catalog.base import Tables
from meterflow.operators import aggregates
from meterflow.plans import forecast, learning

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def known(spark):
    """A target that one feature decides, differently for each unit; one unit has too few rows."""
    rows = [(u, START + dt.timedelta(hours=i), float(i % 7), float(i % 7) * (10 if u == "007" else -3) + 30) for u in ("007", "b/1") for i in range(200)]
    return spark.createDataFrame([*rows, ("c", START, 1.0, 1.0)], "unit string, at timestamp, x double, y double")


def test_boosted_trees_by_unit_learn_and_reload(spark, known, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        reads.add(1)
        return x

    models, metrics = learning.train_each(known.withColumn("x", counted("x")), ["x"], "y", "unit", "at", "boosted", f"{tmp_path}/train", maxIter=15)
    assert {r["unit"]: r["r2"] > 0.95 for r in metrics.collect()} == {"007": True, "b/1": True}
    assert reads.value == known.count()  # one pass over the source, however many models
    plan = learning.ByEntity(known, "unit", f"{tmp_path}/rows").of("007")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(unit" in plan or "PartitionFilters: [isnotnull(unit" in plan
    store = learning.ModelStore(spark, f"{tmp_path}/store")
    assert store.publish(models, ["x"], "y", "boosted") == 1
    direct = {(u, r["at"]): r["prediction"] for u, m in models.items() for r in learning.predict(m, known.filter(F.col("unit") == u)).collect()}
    again = learning.ModelStore(spark.newSession(), f"{tmp_path}/store").score(known, "unit", store=f"{tmp_path}/score").collect()
    assert {(r["unit"], r["at"]): r["prediction"] for r in again if r["unit"] != "c"} == direct
    assert [(r["prediction"], r["model_version"]) for r in again if r["unit"] == "c"] == [(None, None)]
    assert store.publish({"007": models["007"]}, ["x"], "y", "boosted") == 2
    assert {r["entity"]: r["version"] for r in store.current().collect()} == {"007": 2, "b/1": 1}


def test_modes(spark, tmp_path):
    hours = Tables(spark, "/root/testdata/sf0.01").hours.filter("equipment_id IN ('unit_1', 'unit_2')").cache()
    store = learning.ModelStore(spark, str(tmp_path))
    metrics, nothing = learning.run("train", store, hours, kind="forest", numTrees=3)
    assert nothing is None and metrics.count() == 2
    _, ahead = learning.run("predict", learning.ModelStore(spark.newSession(), str(tmp_path)), hours)
    _, both = learning.run("both", learning.ModelStore(spark, f"{tmp_path}/two"), hours, kind="forest", numTrees=3)
    get = lambda df: sorted((r["equipment_id"], r["target_hour"], r["prediction"]) for r in df.collect())
    assert len(get(ahead)) == 48 and get(ahead) == get(both)
    with pytest.raises(ValueError):
        learning.run("sometimes", store, hours)
    assert set(forecast.features(hours)) == set(store.current().first()["features"])


def test_sketches_of_days_unite(spark):
    rows = spark.range(40_000).select((F.col("id") % 9).cast("string").alias("dt"), (F.col("id") % 7001).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id") % 11).alias("few"))
    first = aggregates.distinct_sketches(rows.filter("dt < '5'"), ["dt"], ["k", "few"])
    grown = aggregates.grown_sketches(first, rows, ["dt"], ["k", "few"])
    assert grown.count() == 9
    out = aggregates.distinct_estimates(grown, ["k", "few"]).first()
    assert out["rows"] == 40_000 and abs(out["distinct_k"] - 7001) < 3 * aggregates.SKETCH_ERROR * 7001 and out["distinct_few"] == 11
    empty = aggregates.distinct_estimates(first.limit(0), ["k", "few"]).first()
    assert tuple(empty) == (0, 0, 0)


def test_workloads_give_one_checksum_however_they_are_dealt(spark):
    from meterflow.plans import audit

    hours = Tables(spark, "/root/testdata/sf0.01").hours.cache()
    keys, before = ["station_id", "equipment_id"], spark.conf.get("spark.sql.shuffle.partitions")
    for work in (audit.report_workload, audit.latest_workload, audit.feature_workload):
        runs = []
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            made = work(hours.repartition(int(parts)), keys)
            runs.append(spark.createDataFrame(made.collect(), made.schema))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        found = audit.compare_checksums(*runs).collect()
        assert found and all(r["same"] for r in found)
    off = audit.compare_checksums(runs[0], runs[1].withColumn("output_rows", F.col("output_rows") + 1)).collect()
    assert [r["figure"] for r in off if not r["same"]] == ["output_rows"]
