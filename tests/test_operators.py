"""Hand-built rows for operators' edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterflow.functions import classify, metrics, scalars
from meterflow.operators import aggregates, joins, merge, upsert, windows
from meterflow.plans import advice, hourly, serve, silver
from meterflow.sources import readers, sinks


def at(text):
    return dt.datetime.fromisoformat(text)


def test_gap_fill_and_flags(spark):
    rows = [("a", "temperature", "00:00", 10.0), ("a", "temperature", "00:04", None), ("a", "temperature", "00:20", None), ("b", "status", "00:00", 1.0), ("b", "status", "02:00", 0.0), ("c", "cumulative", "00:00", 5.0), ("c", "cumulative", "00:02", None)]
    df = spark.createDataFrame([(p, t, at(f"2024-01-01 {h}:00"), v) for p, t, h, v in rows], "p string, theme string, ts timestamp, v double")
    out = windows.fill_gaps(df, ["p"], "ts", "v", "theme").withColumn("flag", windows.quality_flag("v", "theme", "gap_s")).orderBy("p", "ts")
    assert [(r["filled"], r["flag"]) for r in out.collect()] == [(10, "normal"), (10, "normal"), (None, "long_missing"), (1, "normal"), (0, "status_stale"), (5, "normal"), (None, "cumulative_gap")]


def test_counter_delta_reset_and_jump(spark):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate([100.0, 150.0, 20.0, 30.0, 900.0])], "m string, h int, v double")
    assert [r["delta"] for r in windows.counter_delta(df, ["m"], "h", "v", 200).orderBy("h").collect()] == [None, 50, None, 10, None]


def test_allocation_without_weight_is_equal(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)], "g string, w double").withColumn("total", F.lit(40.0))
    assert sorted(r["allocated"] for r in windows.allocate(df, ["g"], "w", "total").collect()) == [10, 20, 20, 30]


def test_week_labels(spark):
    df = spark.createDataFrame([(at(f"{d} 12:00:00"),) for d in ("2018-07-29", "2018-12-30", "2018-12-31")], "ts timestamp")
    assert [(str(r[0]), r[1]) for r in df.select(scalars.week_start("ts"), scalars.week_label("ts")).collect()] == [("2018-07-23", "2018-W30"), ("2018-12-24", "2018-W52"), ("2018-12-31", "2019-W01")]


def test_classifier(spark):
    points = spark.createDataFrame([("10LDSCS_T", "2#站10#冷机冷冻水出水温度"), ("SLG_JZ1_DD_YG_ZZ1", "1#发电机电能"), ("X_P", "2#站冷水总管压力")], "point_code string, point_name string")
    out = {r["point_code"]: (r["station_id"], r["system_type"], r["equipment_id"], r["theme"], r["measure_role"]) for r in classify.classify_points(points).collect()}
    assert out["10LDSCS_T"] == ("station_2", "chiller", "chiller_10", "temperature", "supply_temp")
    assert out["SLG_JZ1_DD_YG_ZZ1"] == ("unknown", "generator", "generator_1", "cumulative", None)
    assert out["X_P"][1:3] == ("chiller", "chiller_header")


def test_decode_falls_back_and_survives_bad_json(spark):
    df = spark.createDataFrame([("k", '{"sensor_id":"s","value":1.5}', "sensor_t", 0, 1), ("k", '{"value":2}', "sensor_t", 0, 2), (None, "{bad", "sensor_t", 0, 3)], "key string, value string, topic string, partition int, offset bigint")
    assert [(r["sensor_id"], r["value"]) for r in readers.decode(df).orderBy("offset_id").collect()] == [("s", 1.5), ("k", 2.0), ("t", None)]


def test_dictionary_first_label_wins(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('<c1> rdf:type sosa:FeatureOfInterest ; rdfs:label "一"@zh .\n<c1> rdf:type sosa:FeatureOfInterest ; rdfs:label "二"@zh .', "utf-8")
    assert [tuple(r) for r in readers.dictionary(spark, str(tmp_path)).collect()] == [("c1", "一", 2)]


def test_history_takes_the_sensor_from_the_file(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text("2024-01-01T00:00:00Z\t1.5\n")
    assert [tuple(r) for r in readers.history(spark, str(tmp_path)).collect()] == [("2024-01-01T00:00:00Z", 1.5, "s1")]


def test_upserts(spark):
    target, source = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    get = lambda df: sorted(map(tuple, df.collect()))
    assert get(upsert.upsert(target, source, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert get(upsert.insert_only(target, source.union(source), ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert get(upsert.replace_groups(target, source.limit(0), ["k"])) == get(target)


def test_merge_touches_only_its_partitions(spark, tmp_path):
    path, rows = f"{tmp_path}/t", lambda x: spark.createDataFrame(x, "k int, v string, dt string")
    merge.merge_into(spark, path, rows([(1, "a", "x"), (2, "b", "y")]), ["k"], ["dt"], f"{tmp_path}/s")
    before = {p.name for p in (tmp_path / "t" / "dt=x").iterdir()}
    for _ in range(2):  # a replay changes nothing
        merge.merge_into(spark, path, rows([(2, "c", "y"), (3, "d", "y")]), ["k"], ["dt"], f"{tmp_path}/s")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert {p.name for p in (tmp_path / "t" / "dt=x").iterdir()} == before


def test_lake_copies_once(spark, tmp_path):
    lake = sinks.Lake(str(tmp_path))
    sinks.overwrite(spark.range(3), lake.path("d"))
    assert sinks.copy_if_missing(spark, lake, lake.other("stream"), "d") and not sinks.copy_if_missing(spark, lake, lake.other("stream"), "d")
    assert sinks.read_control(spark, lake, "none", "a int").count() == 0


def test_strict_total_is_unknown_when_a_running_hour_is(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, None), ("b", 0.0, None), ("b", 1.0, 3.0)], "g string, run double, v double")
    out = dict(df.groupBy("g").agg(aggregates.strict_total("v", F.col("run") > 0)).collect())
    assert out == {"a": None, "b": 3.0}


def test_power_estimate_and_tariff(spark):
    df = spark.createDataFrame([(None, 1.0, 10.0, 7.0, 12.0), (5.0, 1.0, 10.0, 7.0, 12.0), (None, 0.0, 10.0, 7.0, 12.0)], "p double, r double, f double, s double, b double")
    assert [r[0] for r in df.select(metrics.power_or_estimate("p", "r", "f", "s", "b")).collect()] == [pytest.approx(10 * 5 * 1.163 / 3), 5.0, None]
    assert [r[0] for r in spark.range(24).select(scalars.tariff("id")).collect()] == [0.4] * 7 + [0.8] + [1.2] * 3 + [0.8] * 7 + [1.2] * 5 + [0.4]


def test_header_fills_units(spark):
    units, header = spark.createDataFrame([(1, None), (2, 3.0)], "k int, v double"), spark.createDataFrame([(1, 9.0)], "k int, v double")
    assert sorted(map(tuple, joins.fill_from_header(units, header, ["k"], "v").collect())) == [(1, 9.0), (2, 3.0)]


def test_advice_fixture(spark):
    row = spark.createDataFrame([("s", "e", 1200.0, 800.0, 2, 1, 7.5, 12.5, 2.2, 85.0, 12.0, 8)], "station_id string, equipment_id string, avg_cooling_6h double, forecast_cooling_6h double, running_units int, run_flag int, avg_supply_temp double, avg_return_temp double, avg_cop double, operation_rate double, start_count_24h double, high_load_hours int")
    assert [r["rule_id"] for r in advice.advise(row).orderBy("rule_id").collect()] == ["R001", "R004", "R005"]


def test_silver_and_hours_end_to_end(spark):
    points = spark.createDataFrame([("10LDSCS_T", "2#站10#冷机冷冻水出水温度"), ("10LDSHS_T", "2#站10#冷机冷冻水回水温度"), ("10_F", "2#站10#冷机流量"), ("10RUN", "2#站10#冷机运行状态")], "point_code string, point_name string")
    values = [("10LDSCS_T", 7.0), ("10LDSHS_T", 12.0), ("10_F", 10.0), ("10RUN", 1.0)]
    readings = spark.createDataFrame([(s, f"2024-01-01T00:{m:02d}:00Z", v) for s, v in values for m in range(3)], "sensor_id string, timestamp string, value double")
    fact = silver.point_fact(readings, classify.classify_points(points))
    status = silver.minute_status(fact)
    assert status.count() == 3
    (hour,) = hourly.chiller_hours(hourly.supply_curve(status)).collect()
    assert hour["supply_kwh"] == pytest.approx(10 * 5 * 1.163) and hour["energy_consumption_kwh"] == pytest.approx(10 * 5 * 1.163 / 3)
    system = hourly.system_hours(hourly.supply_curve(status), fact)
    assert len(system.columns) == 36


def test_heating_and_cchp_hours(spark):
    codes = [("14BOILER_GAS_TOTAL", "1#站1#锅炉燃气累计", "boiler", "boiler_1", "cumulative", None), ("Burner_Load_1", "1#燃烧机负荷", "burner", "burner_1", "load", None), ("Op_Burner_1", "1#燃烧机运行", "burner", "burner_1", "status", "status"), ("P9_ADDH", "三联供冷量累计", "cchp", "P9_ADDH", "cumulative", None)]
    data = [(c, n, "station_1", s, e, t, r, at(f"2024-01-01 0{h}:30:00"), float(v)) for (c, n, s, e, t, r), vs in zip(codes, [(100, 110), (50, 50), (1, 1), (10, 30)]) for h, v in enumerate(vs)]
    fact = spark.createDataFrame(data, "point_code string, point_name string, station_id string, system_type string, equipment_id string, theme string, measure_role string, event_time timestamp, value double")
    heat = {r["stat_hour"].hour if not isinstance(r["stat_hour"], str) else r["stat_hour"]: r for r in hourly.heating_hours(fact).collect()}
    assert heat[1]["supply_kwh"] == pytest.approx(10 * 9.7 * 0.9) and heat[0]["metric_quality"] == "load_estimated"
    cold = [r for r in hourly.cchp_hours(fact).collect() if r["supply_kwh"]]
    assert [(r["cooling_supply_kwh"], r["energy_consumption_kwh"]) for r in cold] == [(20.0, 25.0)]


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        serve.query(spark.range(1), limit=0)
