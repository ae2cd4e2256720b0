"""The forest's future features and band against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterflow.catalog import business
from meterflow.plans import forecast

START = dt.datetime(2024, 1, 1)


def series(unit, system, n):
    return [("s", system, unit, START + dt.timedelta(hours=i), float(i % 24 * 10 + i // 24), 7.0 + i % 24, 12.0 + 2 * (i % 24), 3.0, 5.0 + i % 24, 40.0 + i % 5) for i in range(n)]


@pytest.fixture(scope="module")
def hours(spark):
    rows = series("u1", "chiller", 400) + series("u2", "heating", 300)
    return spark.createDataFrame(rows, "station_id string, system_type string, equipment_id string, stat_hour timestamp, supply_kwh double, avg_supply_temp double, avg_return_temp double, avg_flow double, avg_power double, operation_rate double")


def test_future_features_are_known_values(hours):
    out = forecast.future_features(hours)
    rows = {(r["equipment_id"], r["forecast_hour_offset"]): r for r in out.collect()}
    assert len(rows) == 48 and set(forecast.features(hours)) <= set(out.columns)
    for unit, system, n in (("u1", "chiller", 400), ("u2", "heating", 300)):
        own = series(unit, system, n)
        supply = [r[4] for r in own]
        for k in range(1, 25):
            r, at = rows[unit, k], n - 1 + k
            alike = [x for x in own if x[3].hour == (START + dt.timedelta(hours=at)).hour]
            mean = lambda i: sum(x[i] for x in alike) / len(alike)  # noqa: B023, E731
            assert (r["lag_1"], r["lag_24"], r["lag_168"]) == (supply[-1], supply[at - 24], supply[at - 168])
            assert r["avg_168"] == pytest.approx(sum(supply[-168:]) / 168) and r["max_168"] == max(supply[-168:])
            for name, i in (("avg_supply_temp", 5), ("avg_return_temp", 6), ("avg_flow", 7), ("avg_power", 8), ("operation_rate", 9)):
                assert r[name] == pytest.approx(mean(i))
            assert r["temp_difference"] == pytest.approx((mean(6) - mean(5)) * (1 if system == "chiller" else -1))


def test_forecast_is_made_on_them_with_a_band_of_rmse(spark, hours):
    class T:
        pass

    t = T()
    t.spark, t.hours = spark, hours
    rmse = {r["equipment_id"]: r["rmse"] for r in business.forest_metrics(t).collect()}
    rows = business.forest_forecast(t).collect()
    assert len(rows) == 48 and len(rmse) == 2
    for r in rows:
        assert r["confidence_upper"] == pytest.approx(r["prediction"] + 1.28 * rmse[r["equipment_id"]])
        assert r["confidence_lower"] == pytest.approx(max(r["prediction"] - 1.28 * rmse[r["equipment_id"]], 0))
    known = business.forest_importances(t).first()["top_features"]
    assert "avg_supply_temp" in known or "avg_power" in known or "avg_return_temp" in known


def test_hours_without_covariates(hours):
    out = forecast.future_features(hours.select("system_type", "equipment_id", "stat_hour", "supply_kwh"))
    assert out.filter(F.col("lag_1").isNull()).count() == 0 and out.count() == 48
