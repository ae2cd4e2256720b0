"""Silver rules on hand-built rows: what a reading becomes, and what it does not."""

import pytest
from pyspark.sql import functions as F

from meterflow.functions.classify import classify_points
from meterflow.plans import hourly, silver
from meterflow.sources.schemas import HOURLY, HOURLY_DOUBLES

POINTS = [("r", "1#站1#冷机运行状态"), ("h", "1#站1#冷机运行时间"), ("s", "1#站1#冷机启动次数"), ("x_LDSCS_T", "1#站1#冷机"), ("x_LDSHS_T", "1#站1#冷机"), ("f", "1#站1#冷机流量"), ("l", "1#站1#燃烧机负荷"), ("p", "1#站冷水总管压力"), ("m", "1#站1#锅炉累计")]


@pytest.fixture(scope="module")
def points(spark):
    return classify_points(spark.createDataFrame(POINTS, "point_code string, point_name string"))


def readings(spark, rows):
    return spark.createDataFrame(rows, "sensor_id string, timestamp string, value double")


def test_a_stopped_chiller_with_an_hour_meter_does_not_run(spark, points):
    at = "2024-01-01T00:00:10Z"
    rows = [("r", at, 0.0), ("h", at, 5321.0), ("s", at, 12.0), ("x_LDSCS_T", at, 7.0), ("x_LDSHS_T", at, 12.0), ("f", at, 100.0), ("p", at, 0.4)]
    fact = silver.point_fact(readings(spark, rows), points)
    row = silver.minute_status(fact).first()
    assert (row["run_flag"], row["runtime_hours"], row["start_count"], row["supply_temp"], row["return_temp"], row["pressure"]) == (0.0, 5321.0, 12.0, 7.0, 12.0, 0.4)
    assert row["power"] is None  # no estimate for a stopped unit
    hour = hourly.supply_curve(silver.minute_status(fact)).first()
    assert (hour["runtime_hours"], hour["energy_consumption_kwh"], hour["cooling_supply_kwh"], hour["cumulative_runtime_hours"]) == (0.0, 0.0, 0.0, 5321.0)


def test_a_running_chiller_without_power_gets_an_estimate(spark, points):
    at = "2024-01-01T00:00:10Z"
    rows = [("r", at, 1.0), ("x_LDSCS_T", at, 7.0), ("x_LDSHS_T", at, 12.0), ("f", at, 100.0)]
    row = silver.minute_status(silver.point_fact(readings(spark, rows), points)).first()
    assert row["power"] == pytest.approx(1.163 * 100 * 5 / 3)


def test_gaps_and_flags(spark, points):
    rows = [("r", "2024-01-01T00:00:00Z", 1.0), ("r", "2024-01-01T01:00:00Z", None), ("r", "2024-01-01T03:00:00Z", 1.0)]
    rows += [("l", "2024-01-01T00:00:00Z", 5.0), ("l", "2024-01-01T00:01:00Z", None), ("f", "2024-01-01T00:00:00Z", 5.0), ("f", "2024-01-01T00:01:00Z", None)]
    rows += [("m", "2024-01-01T00:00:00Z", 5.0), ("m", "2024-01-01T00:01:00Z", None)]
    fact = silver.point_fact(readings(spark, rows), points).orderBy("point_code", "event_time")
    found = {(r["point_code"], r["event_time"].strftime("%H:%M")): (r["value"], r["quality_flag"]) for r in fact.collect()}
    assert found["r", "01:00"] == (1.0, "long_missing")  # filled from the row before, and flagged
    assert found["r", "03:00"] == (1.0, "status_stale")
    assert found["l", "00:01"] == (None, "normal")  # a load is not carried
    assert found["f", "00:01"] == (5.0, "normal")
    assert found["m", "00:01"] == (None, "cumulative_gap")


def test_readings_of_unknown_points_stay(spark, points):
    rows = [("r", "2024-01-01T00:00:00Z", 1.0), ("ghost", "2024-01-01T00:00:00Z", 2.0), ("r", "no time", 1.0)]
    for fact in (silver.point_fact(readings(spark, rows), points), silver.stream_fact(readings(spark, rows), points)):
        assert sorted((r["point_code"], r["station_id"]) for r in fact.collect()) == [("ghost", None), ("r", "station_1")]


def test_every_hourly_table_has_the_same_types(spark, points):
    fact = silver.point_fact(readings(spark, [("r", "2024-01-01T00:00:10Z", 1.0)]), points)
    made = hourly.system_hours(hourly.supply_curve(silver.minute_status(fact)), fact)
    assert made.columns == HOURLY and all(dict(made.dtypes)[c] == "double" for c in HOURLY_DOUBLES)
    bare = hourly.conform(spark.range(1).select(F.lit("s").alias("station_id"), F.lit("e").alias("equipment_id"), F.current_timestamp().alias("stat_hour"), F.current_date().alias("dt")), "x", "y")
    assert dict(bare.dtypes)["run_minutes"] == dict(bare.dtypes)["operation_rate"] == "double"


@pytest.mark.parametrize("cap,build", [("MOST_GAS", "heating_hours"), ("MOST_HEAT", "cchp_hours"), ("MOST_ELECTRIC", "cchp_hours"), ("MOST_GENERATOR_GAS", "cchp_hours")])
def test_the_builds_data_reach_every_cap(spark, monkeypatch, cap, build):
    """A query that is compared with SQL turns red when a largest advance is changed."""
    from meterflow.catalog import QUERIES
    from meterflow.plans import hourly

    rows = lambda: sorted(map(str, QUERIES[build](spark, "/root/testdata/sf0.01").collect()))
    before = rows()
    monkeypatch.setattr(hourly, cap, getattr(hourly, cap) * 2)
    assert rows() != before
