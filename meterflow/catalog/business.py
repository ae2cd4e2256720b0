"""Queries of hourly metrics, reports, forecasts, revenue, advice and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow.catalog.base import query
from meterflow.functions import metrics, scalars
from meterflow.operators import windows
from meterflow.plans import advice, forecast, learning, reports

ENTITY = ["station_id", "system_type", "equipment_id"]


@query("""
    SELECT equipment_id, stat_hour, coalesce(avg_power, CASE WHEN runtime_hours > 0 AND avg_flow > 0 AND avg_return_temp - avg_supply_temp > 0 THEN avg_flow * (avg_return_temp - avg_supply_temp) * 1.163 / 3.0 END) AS power_filled,
           CASE WHEN runtime_hours <= 0 THEN 0 ELSE avg_power * runtime_hours END AS energy,
           CASE WHEN runtime_hours <= 0 THEN 0 ELSE coalesce(CASE WHEN avg_flow IS NOT NULL AND avg_return_temp - avg_supply_temp > 0 THEN avg_flow * (avg_return_temp - avg_supply_temp) * 1.163 END, avg_power * 3.0) END AS capacity,
           avg_flow * 9.7 AS gas_kwh, avg_flow * 9.7 * 0.9 AS gas_heat, coalesce(CASE WHEN energy_consumption_kwh > 0 THEN supply_kwh / energy_consumption_kwh END, CASE WHEN avg_pressure > 0 THEN avg_flow / avg_pressure END, 0) AS cop,
           CASE WHEN coalesce(supply_kwh, 0) <> 0 THEN supply_kwh ELSE coalesce(cooling_supply_kwh, 0) + coalesce(heating_supply_kwh, 0) + coalesce(electric_supply_kwh, 0) END AS primary_supply,
           CASE WHEN coalesce(cooling_supply_kwh, 0) <> 0 THEN cooling_supply_kwh ELSE coalesce(heating_supply_kwh, 0) + coalesce(electric_supply_kwh, 0) END AS other_supply FROM hours""",
       doubles="power_filled energy capacity gas_kwh gas_heat cop primary_supply other_supply", times="stat_hour")
def physical_metrics(t):
    power = metrics.power_or_estimate("avg_power", "runtime_hours", "avg_flow", "avg_supply_temp", "avg_return_temp")
    capacity = metrics.cooling_capacity("runtime_hours", "avg_flow", "avg_supply_temp", "avg_return_temp", "avg_power")
    return t.hours.select(
        "equipment_id", "stat_hour", power.alias("power_filled"), metrics.energy("runtime_hours", "avg_power").alias("energy"), capacity.alias("capacity"), metrics.gas_energy("avg_flow").alias("gas_kwh"), metrics.gas_heat("avg_flow").alias("gas_heat"),
        metrics.row_cop("supply_kwh", "energy_consumption_kwh", "avg_flow", "avg_pressure").alias("cop"), metrics.primary_supply("supply_kwh", "cooling_supply_kwh", "heating_supply_kwh", "electric_supply_kwh").alias("primary_supply"),
        metrics.primary_supply("cooling_supply_kwh", "heating_supply_kwh", "electric_supply_kwh").alias("other_supply"),
    )


@query("""
    SELECT equipment_id, stat_hour, coalesce(runtime_hours, CASE WHEN load_pct > 0 THEN least(load_pct / 100, 1.0) END, 0) AS runtime, CASE WHEN r > 0 THEN CASE WHEN load_pct > 0 THEN r * load_pct ELSE r END ELSE 0 END AS weight, grp,
           CASE WHEN measured IS NULL THEN 'load_estimated' WHEN load_pct > 0 THEN 'gas_delta_allocated_by_load' ELSE 'gas_delta_equal_allocated' END AS quality, coalesce(measured, CASE WHEN supply_kwh > 0 THEN supply_kwh / 0.8 END, 0) AS input_kwh
    FROM (SELECT *, avg_power AS load_pct, avg_flow * 9.7 AS measured, coalesce(runtime_hours, CASE WHEN avg_power > 0 THEN least(avg_power / 100, 1.0) END, 0) AS r, CASE WHEN equipment_id IN ('unit_1', 'unit_4') THEN '14' ELSE '23' END AS grp FROM hours)""",
       doubles="runtime weight input_kwh", times="stat_hour")
def burner_metrics(t):
    rows = t.hours.withColumns({"load_pct": F.col("avg_power"), "measured": metrics.gas_energy("avg_flow"), "number": F.regexp_extract("equipment_id", "([0-9]+)$", 1)}).withColumn("runtime", metrics.burner_runtime("runtime_hours", "load_pct"))
    return rows.select("equipment_id", "stat_hour", "runtime", metrics.allocation_weight("runtime", "load_pct").alias("weight"), metrics.gas_group("number").alias("grp"), metrics.heating_quality(F.col("measured"), F.col("load_pct")).alias("quality"), metrics.cchp_input("measured", "supply_kwh").alias("input_kwh"))


_TARIFF = "CASE WHEN hour({h}) BETWEEN 8 AND 10 OR hour({h}) BETWEEN 18 AND 22 THEN 1.2 WHEN hour({h}) BETWEEN 7 AND 17 THEN 0.8 ELSE 0.4 END"


@query(f"SELECT event_id, {_TARIFF.format(h='event_time')} AS price FROM readings", doubles="price")
def tariff_prices(t):
    return t.readings.select("event_id", scalars.tariff(F.hour("event_time")).alias("price"))


_PERIODS = {
    "day": ("strftime(stat_hour, '%Y-%m-%d') AS stat_date", "stat_date", "24.0"),
    "week": ("strftime(date_trunc('week', stat_hour), '%Y-%m-%d') AS week_start_date, year(date_trunc('week', stat_hour) + INTERVAL 3 DAY) || '-W' || lpad(week(stat_hour)::VARCHAR, 2, '0') AS stat_week", "week_start_date, stat_week", "168.0"),
    "month": ("strftime(stat_hour, '%Y-%m') AS stat_month", "stat_month", "day(last_day(stat_hour)) * 24.0"),
}


def report_sql(period: str) -> str:
    named, names, expected = _PERIODS[period]
    return f"""
    SELECT r.* EXCLUDE (electricity_price, cooling_price, heating_price, gas_price), total_energy_consumption_kwh * input_energy_price AS total_energy_cost,
           total_cooling_supply_kwh * cooling_price + total_heating_supply_kwh * heating_price + total_electric_supply_kwh * electricity_price AS total_supply_revenue,
           total_cooling_supply_kwh * cooling_price + total_heating_supply_kwh * heating_price + total_electric_supply_kwh * electricity_price - total_energy_consumption_kwh * input_energy_price AS net_profit FROM (
    SELECT *, CASE WHEN system_type IN ('heating', 'cchp') THEN gas_price ELSE electricity_price END AS input_energy_price, CASE WHEN valley_supply_kwh > 0 THEN peak_supply_kwh / valley_supply_kwh END AS peak_valley_ratio,
           CASE WHEN total_energy_consumption_kwh > 0 THEN total_supply_kwh / total_energy_consumption_kwh END AS avg_cop, total_run_minutes / 60 AS total_runtime_hours, total_run_minutes / (expected_hours * 60) AS equipment_utilization_rate,
           CASE WHEN peak_supply_kwh > 0 THEN avg_supply_kwh / peak_supply_kwh END AS load_factor, hour_count / expected_hours AS data_completeness_rate FROM (
    SELECT station_id, system_type, equipment_id, {names}, max(s) AS peak_supply_kwh, min(s) FILTER (s > 0) AS valley_supply_kwh, sum(s) AS total_supply_kwh, sum(coalesce(cooling_supply_kwh, 0)) AS total_cooling_supply_kwh,
           sum(coalesce(heating_supply_kwh, 0)) AS total_heating_supply_kwh, sum(coalesce(electric_supply_kwh, 0)) AS total_electric_supply_kwh, sum(coalesce(energy_consumption_kwh, 0)) AS total_energy_consumption_kwh, sum(coalesce(run_minutes, 0)) AS total_run_minutes,
           avg(s) AS avg_supply_kwh, avg(avg_supply_temp) AS avg_supply_temp, avg(operation_rate) AS avg_operation_rate, count(*) AS hour_count, count(*) FILTER (supply_kwh IS NULL) AS missing_supply_hours, count(*) FILTER (energy_consumption_kwh IS NULL) AS missing_energy_hours,
           count(*) FILTER (s > 0 AND coalesce(operation_rate, 0) <= 0) AS anomaly_count, sum((s > m * 1.2)::INT) AS peak_duration_hours, sum((s > 0 AND s < m * 0.8)::INT) AS valley_duration_hours, max(expected) AS expected_hours
    FROM (SELECT *, avg(s) OVER (PARTITION BY station_id, system_type, equipment_id, {names}) AS m FROM (SELECT *, {named}, {expected} AS expected, coalesce(supply_kwh, 0) AS s FROM hours)) GROUP BY ALL), price_row) r"""


_REPORT = dict(doubles="peak_supply_kwh valley_supply_kwh total_supply_kwh total_cooling_supply_kwh total_heating_supply_kwh total_electric_supply_kwh total_energy_consumption_kwh total_run_minutes avg_supply_kwh avg_supply_temp avg_operation_rate expected_hours peak_valley_ratio avg_cop total_runtime_hours equipment_utilization_rate load_factor data_completeness_rate input_energy_price total_energy_cost total_supply_revenue net_profit", longs="peak_duration_hours valley_duration_hours")


@query(report_sql("day"), **_REPORT)
def report_day(t):
    return reports.system_report(t.hours, "day", t.price_row)


@query(report_sql("week"), **_REPORT)
def report_week(t):
    return reports.system_report(t.hours, "week", t.price_row)


@query(report_sql("month"), **_REPORT)
def report_month(t):
    return reports.system_report(t.hours, "month", t.price_row)


def tariff_sql(hour: str) -> str:
    return _TARIFF.format(h=hour)


def chiller_sql(period: str, price: str) -> str:
    named, names, expected = _PERIODS[period]
    strict = lambda c: f"CASE WHEN count(*) FILTER (runtime_hours > 0 AND {c} IS NULL) = 0 THEN coalesce(sum({c}), 0) END"
    return f"""
    SELECT *, cooling_revenue - energy_cost AS net_profit FROM (SELECT *, CASE WHEN total_energy_consumption_kwh > 0 THEN total_cooling_supply_kwh / total_energy_consumption_kwh END AS avg_cop, CASE WHEN valley_cooling_kwh > 0 THEN peak_cooling_kwh / valley_cooling_kwh END AS peak_valley_ratio,
           total_cooling_supply_kwh * 0.3 AS cooling_revenue, hour_count / expected_hours AS data_completeness_rate FROM (
    SELECT station_id, equipment_id, {names}, max(s) AS peak_cooling_kwh, min(s) FILTER (s > 0) AS valley_cooling_kwh, {strict("s")} AS total_cooling_supply_kwh, {strict("energy_consumption_kwh")} AS total_energy_consumption_kwh, {strict("cost")} AS energy_cost,
           sum(runtime_hours) AS total_runtime_hours, sum((s > m * 1.2)::INT) AS peak_duration_hours, sum((s > 0 AND s < m * 0.8)::INT) AS valley_duration_hours, count(*) AS hour_count, max(expected) AS expected_hours
    FROM (SELECT *, avg(s) OVER (PARTITION BY station_id, equipment_id, {names}) AS m FROM (SELECT *, {named}, {expected} AS expected, cooling_supply_kwh AS s, energy_consumption_kwh * {price} AS cost FROM hours)) GROUP BY ALL))"""


_CHILLER = dict(doubles="peak_cooling_kwh valley_cooling_kwh total_cooling_supply_kwh total_energy_consumption_kwh energy_cost total_runtime_hours expected_hours avg_cop peak_valley_ratio cooling_revenue data_completeness_rate net_profit", longs="peak_duration_hours valley_duration_hours")


@query(chiller_sql("day", "0.8"), **_CHILLER)
def chiller_report_day(t):
    return reports.chiller_report(t.hours, "day")


@query(chiller_sql("week", _TARIFF.format(h="stat_hour")), **_CHILLER)
def chiller_report_week(t):
    return reports.tariff_report(t.hours, "week")


@query(chiller_sql("month", _TARIFF.format(h="stat_hour")), **_CHILLER)
def chiller_report_month(t):
    return reports.tariff_report(t.hours, "month")


@query("""
    SELECT *, CASE WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 60 THEN 'warning' ELSE 'poor' END AS quality_flag FROM (
    SELECT *, (0.4 * completeness + 0.6 * ((avg_supply_temp_valid_rate + avg_power_valid_rate) / 2)) * 100 AS quality_score FROM (
    SELECT equipment_id, strftime(stat_hour, '%Y-%m-%d') AS day, count(*) AS hour_count, CASE WHEN count(*) FILTER (r) > 0 THEN count(*) FILTER (r AND avg_supply_temp IS NOT NULL) / count(*) FILTER (r) ELSE 1.0 END AS avg_supply_temp_valid_rate,
           CASE WHEN count(*) FILTER (r) > 0 THEN count(*) FILTER (r AND avg_power IS NOT NULL) / count(*) FILTER (r) ELSE 1.0 END AS avg_power_valid_rate, count(*) FILTER (avg_supply_temp = 0) AS avg_supply_temp_zeros, count(*) FILTER (avg_power = 0) AS avg_power_zeros,
           count(*) FILTER (avg_supply_temp IS NULL) AS avg_supply_temp_nulls, count(*) FILTER (avg_power IS NULL) AS avg_power_nulls, least(count(*) / 24.0, 1.0) AS completeness FROM (SELECT *, supply_kwh > 0 AS r FROM hours) GROUP BY ALL))""",
       doubles="avg_supply_temp_valid_rate avg_power_valid_rate completeness quality_score")
def data_quality_day(t):
    return quality_rows(t)


def quality_rows(t):
    rows = t.hours.withColumn("day", F.to_date("stat_hour").cast("string"))
    return reports.data_quality(rows, ["avg_supply_temp", "avg_power"], F.col("supply_kwh") > 0, ["equipment_id", "day"])


@query(f"""
    SELECT stat_date, count(DISTINCT equipment_id) AS equipment, sum(total_supply_kwh) AS total_supply_kwh, sum(total_energy_consumption_kwh) AS total_energy_consumption_kwh, max(peak_supply_kwh) AS peak_supply_kwh, min(valley_supply_kwh) FILTER (valley_supply_kwh > 0) AS valley_supply_kwh,
           sum(hour_count) AS hour_count, CASE WHEN min(valley_supply_kwh) FILTER (valley_supply_kwh > 0) > 0 THEN max(peak_supply_kwh) / min(valley_supply_kwh) FILTER (valley_supply_kwh > 0) END AS peak_valley_ratio, sum(total_supply_kwh) / sum(hour_count) AS mean_supply_kwh,
           CASE WHEN sum(total_energy_consumption_kwh) > 0 THEN sum(total_supply_kwh) / sum(total_energy_consumption_kwh) END AS cop FROM ({report_sql("day")}) GROUP BY ALL""",
       doubles="total_supply_kwh total_energy_consumption_kwh peak_supply_kwh valley_supply_kwh peak_valley_ratio mean_supply_kwh cop", longs="hour_count")
def report_across_equipment(t):
    report = reports.system_report(t.hours, "day").withColumn("stat_date", F.col("stat_date").cast("string"))
    return reports.across_equipment(report, ["stat_date"])


# Forecast


@query("""
    SELECT event_id, month(event_time) AS month, day(event_time) AS day_of_month, (dayofweek(event_time) + 6) % 7 AS day_of_week, hour(event_time) AS hour_of_day, CASE WHEN (dayofweek(event_time) + 6) % 7 >= 5 THEN 1 ELSE 0 END AS is_weekend, 0 AS season,
           sin(hour(event_time) * (2 * pi() / 24)) AS hour_sin, cos(hour(event_time) * (2 * pi() / 24)) AS hour_cos, sin(((dayofweek(event_time) + 6) % 7) * (2 * pi() / 7)) AS dow_sin, cos(((dayofweek(event_time) + 6) % 7) * (2 * pi() / 7)) AS dow_cos,
           sin(month(event_time) * (2 * pi() / 12)) AS month_sin, cos(month(event_time) * (2 * pi() / 12)) AS month_cos FROM readings""",
       doubles="hour_sin hour_cos dow_sin dow_cos month_sin month_cos", longs="month day_of_month day_of_week hour_of_day is_weekend season")
def calendar_features(t):
    made = forecast.calendar_features(t.readings, "event_time")
    return made.select("event_id", "month", "day_of_month", "day_of_week", "hour_of_day", "is_weekend", "season", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")


@query("""SELECT equipment_id, stat_hour, CASE WHEN system_type = 'chiller' THEN 1 ELSE -1 END * (coalesce(avg_return_temp, 0) - coalesce(avg_supply_temp, 0)) AS temp_difference, coalesce(lag(supply_kwh, 24) OVER w, 0) AS lag_24, coalesce(avg(supply_kwh) OVER (w ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), 0) AS avg_168
    FROM hours WINDOW w AS (PARTITION BY system_type, equipment_id ORDER BY stat_hour)""", doubles="temp_difference lag_24 avg_168", times="stat_hour")
def training_features(t):
    return forecast.training_features(t.hours).select("equipment_id", "stat_hour", "temp_difference", "lag_24", "avg_168")


@query("""SELECT equipment_id, last_hour, o AS forecast_hour_offset, last_hour + o * INTERVAL 1 HOUR AS target_hour FROM (SELECT equipment_id, max(stat_hour) AS last_hour FROM hours GROUP BY ALL), range(1, 25) r(o)""", times="last_hour target_hour")
def future_hours(t):
    return forecast.future_hours(t.hours, ["equipment_id"], "stat_hour")


_FUTURE = "SELECT system_type, equipment_id, o AS forecast_hour_offset, last_hour + o * INTERVAL 1 HOUR AS target_hour FROM (SELECT system_type, equipment_id, max(stat_hour) AS last_hour FROM hours GROUP BY ALL), range(1, 25) r(o)"


_HOURLY_PROFILE = ", ".join(f"avg({c}) AS {c}" for c in forecast.COVARIATES)
_PROFILED = ", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in forecast.COVARIATES)


@query(f"""SELECT f.equipment_id, f.target_hour, coalesce(c.supply_kwh, l.supply_kwh) AS lag_1, coalesce(a.supply_kwh, l.supply_kwh) AS lag_24, coalesce(b.supply_kwh, l.supply_kwh) AS lag_168, l.avg_24, l.max_24, l.avg_168, l.max_168, {_PROFILED},
    CASE WHEN f.system_type = 'chiller' THEN 1 ELSE -1 END * (coalesce(p.avg_return_temp, 0) - coalesce(p.avg_supply_temp, 0)) AS temp_difference FROM ({_FUTURE}) f
    LEFT JOIN hours c ON c.equipment_id = f.equipment_id AND c.stat_hour = f.target_hour - INTERVAL 1 HOUR
    LEFT JOIN (SELECT equipment_id, hour(stat_hour) AS h, {_HOURLY_PROFILE} FROM hours GROUP BY ALL) p ON p.equipment_id = f.equipment_id AND p.h = hour(f.target_hour)
    LEFT JOIN hours a ON a.equipment_id = f.equipment_id AND a.stat_hour = f.target_hour - INTERVAL 24 HOUR LEFT JOIN hours b ON b.equipment_id = f.equipment_id AND b.stat_hour = f.target_hour - INTERVAL 168 HOUR
    JOIN (SELECT equipment_id, stat_hour, supply_kwh, coalesce(avg(supply_kwh) OVER d, supply_kwh) AS avg_24, coalesce(max(supply_kwh) OVER d, supply_kwh) AS max_24, coalesce(avg(supply_kwh) OVER w, supply_kwh) AS avg_168, coalesce(max(supply_kwh) OVER w, supply_kwh) AS max_168
          FROM hours WINDOW d AS (PARTITION BY equipment_id ORDER BY stat_hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), w AS (PARTITION BY equipment_id ORDER BY stat_hour ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)
          QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY stat_hour DESC) = 1) l ON l.equipment_id = f.equipment_id""",
       doubles=f"lag_1 lag_24 lag_168 avg_24 max_24 avg_168 max_168 temp_difference {' '.join(forecast.COVARIATES)}", times="target_hour")
def future_features(t):
    return forecast.future_features(t.hours).select("equipment_id", "target_hour", "lag_1", "lag_24", "lag_168", "avg_24", "max_24", "avg_168", "max_168", *forecast.COVARIATES, "temp_difference")


FORECAST_SQL = f"""
    SELECT system_type, equipment_id, forecast_hour_offset, target_hour, profile_sample_count, p AS predicted_supply_kwh, p * cs AS predicted_cooling_kwh, p * hs AS predicted_heating_kwh, p * es AS predicted_electric_kwh, p * en AS predicted_energy_kwh,
           greatest(p - p * g, 0) AS confidence_lower, p + p * g AS confidence_upper FROM (
    SELECT f.*, a.n AS profile_sample_count, coalesce(a.m, b.m, c.m, 0) AS p, CASE WHEN a.n >= 8 THEN 0.15 ELSE 0.25 END AS g, cs, hs, es, en FROM ({_FUTURE}) f
    LEFT JOIN (SELECT equipment_id, hour(stat_hour) AS h, dayofweek(stat_hour) AS d, avg(coalesce(supply_kwh, 0)) AS m, count(*) AS n FROM hours GROUP BY ALL) a ON a.equipment_id = f.equipment_id AND a.h = hour(f.target_hour) AND a.d = dayofweek(f.target_hour)
    LEFT JOIN (SELECT equipment_id, hour(stat_hour) AS h, avg(coalesce(supply_kwh, 0)) AS m FROM hours GROUP BY ALL) b ON b.equipment_id = f.equipment_id AND b.h = hour(f.target_hour)
    LEFT JOIN (SELECT equipment_id, avg(coalesce(supply_kwh, 0)) AS m, sum(cooling_supply_kwh) / sum(supply_kwh) AS cs, sum(heating_supply_kwh) / sum(supply_kwh) AS hs, sum(electric_supply_kwh) / sum(supply_kwh) AS es, sum(energy_consumption_kwh) / sum(supply_kwh) AS en FROM hours GROUP BY ALL) c ON c.equipment_id = f.equipment_id)"""
_FORECAST = dict(doubles="predicted_supply_kwh predicted_cooling_kwh predicted_heating_kwh predicted_electric_kwh predicted_energy_kwh confidence_lower confidence_upper", times="target_hour")


@query(FORECAST_SQL, **_FORECAST)
def seasonal_forecast(t):
    return forecast.seasonal_forecast(t.hours)


REVENUE_SQL = f"""
    SELECT *, CASE WHEN predicted_supply_revenue > 0 THEN predicted_profit / predicted_supply_revenue ELSE 0 END AS profit_margin FROM (SELECT *, predicted_supply_revenue - predicted_energy_cost AS predicted_profit FROM (
    SELECT system_type, equipment_id, forecast_hour_offset, target_hour, predicted_cooling_kwh * cooling_price + predicted_heating_kwh * heating_price + predicted_electric_kwh * electricity_price AS predicted_supply_revenue,
           predicted_energy_kwh * CASE WHEN system_type IN ('heating', 'cchp') THEN gas_price ELSE electricity_price END AS predicted_energy_cost FROM ({FORECAST_SQL}) f, price_row))"""


def revenue_of(t):
    return forecast.revenue(forecast.seasonal_forecast(t.hours), t.price_row)


@query(REVENUE_SQL, doubles="predicted_supply_revenue predicted_energy_cost predicted_profit profit_margin", times="target_hour")
def revenue_forecast(t):
    return revenue_of(t).select("system_type", "equipment_id", "forecast_hour_offset", "target_hour", "predicted_supply_revenue", "predicted_energy_cost", "predicted_profit", "profit_margin")


@query(f"SELECT equipment_id, target_hour, predicted_cooling_kwh * 0.3 AS predicted_revenue, predicted_cooling_kwh / 3.5 * {_TARIFF.format(h='target_hour')} AS predicted_cost, predicted_cooling_kwh * 0.3 - predicted_cooling_kwh / 3.5 * {_TARIFF.format(h='target_hour')} AS predicted_profit FROM ({FORECAST_SQL})", doubles="predicted_revenue predicted_cost predicted_profit", times="target_hour")
def cooling_revenue_forecast(t):
    return forecast.cooling_revenue(forecast.seasonal_forecast(t.hours)).select("equipment_id", "target_hour", "predicted_revenue", "predicted_cost", "predicted_profit")


@query(f"SELECT equipment_id, target_hour AS first_hour, predicted_supply_kwh, (confidence_upper - confidence_lower) / 2 AS half_width, 'from_forecast' AS metrics_source FROM ({FORECAST_SQL}) WHERE forecast_hour_offset = 1", doubles="predicted_supply_kwh half_width", times="first_hour")
def metrics_from_forecast(t):
    return forecast.metrics_from_forecast(forecast.seasonal_forecast(t.hours)).drop("system_type")


@query("""
    SELECT equipment_id, count(*) AS n, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, avg(abs(a - p) / a) FILTER (a > 0) * 100 AS mape, stddev_pop(a - p) AS residual_std, 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) AS r2
    FROM (SELECT equipment_id, supply_kwh AS a, lag(supply_kwh, 24) OVER (PARTITION BY equipment_id ORDER BY stat_hour) AS p FROM hours) WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY ALL""", doubles="mae rmse mape residual_std r2")
def evaluate_lag_forecast(t):
    """Metrics of the value 24 rows before as a forecast."""
    rows = windows.lags(t.hours, ["equipment_id"], ["stat_hour"], "supply_kwh", (24,))
    return forecast.evaluate(rows, ["equipment_id"], "supply_kwh", "lag_24")


@query("""
    WITH lagged AS (SELECT equipment_id, stat_hour, supply_kwh AS a, lag(supply_kwh, 24) OVER (PARTITION BY equipment_id ORDER BY stat_hour) AS p FROM hours)
    SELECT equipment_id, stat_hour, greatest(p - s * 1.2816, 0) AS confidence_lower, p + s * 1.2816 AS confidence_upper
    FROM lagged JOIN (SELECT equipment_id, stddev_pop(a - p) AS s FROM lagged WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY ALL) USING (equipment_id) WHERE p IS NOT NULL AND s IS NOT NULL""", doubles="confidence_lower confidence_upper", times="stat_hour")
def confidence_band(t):
    """The value 24 rows before as a forecast, with a band by the deviation of the unit's own residuals."""
    rows = windows.lags(t.hours, ["equipment_id"], ["stat_hour"], "supply_kwh", (24,)).filter("lag_24 IS NOT NULL")
    spread = forecast.evaluate(rows, ["equipment_id"], "supply_kwh", "lag_24").select("equipment_id", "residual_std")
    return forecast.band(rows.join(spread, "equipment_id"), "lag_24", "residual_std").select("equipment_id", "stat_hour", "confidence_lower", "confidence_upper")


@query("""
    SELECT equipment_id, sum(coalesce(supply_kwh, 0)) AS recent_supply_kwh, avg(coalesce(operation_rate, 0)) AS recent_operation_rate, CASE WHEN sum(coalesce(supply_kwh, 0)) <= 1e-6 AND avg(coalesce(operation_rate, 0)) <= 1e-6 THEN 'inactive' ELSE 'active' END AS activity
    FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY stat_hour DESC) AS rn FROM hours) WHERE rn <= 24 GROUP BY ALL""", doubles="recent_supply_kwh recent_operation_rate")
def recent_activity(t):
    return forecast.recent_activity(t.hours).select("equipment_id", "recent_supply_kwh", "recent_operation_rate", "activity")


def _train(t, kind, **changes):
    rows = forecast.training_features(t.hours.filter("supply_kwh IS NOT NULL"))
    return learning.train_and_evaluate(rows, forecast.features(t.hours), "supply_kwh", ["equipment_id"], "stat_hour", kind, **changes)


@query()
def forest_metrics(t):
    """Held-out metrics of a random forest over all units."""
    return _train(t, "forest")[1]


@query()
def forest_metrics_by_unit(t):
    """Held-out metrics of a random forest of its own for each unit."""
    rows = forecast.training_features(t.hours.filter("supply_kwh IS NOT NULL"))
    return learning.train_each(rows, forecast.features(t.hours), "supply_kwh", "equipment_id", "stat_hour")[1]


@query()
def boosted_metrics(t):
    """Held-out metrics of boosted trees."""
    return _train(t, "boosted")[1]


@query()
def boosted_metrics_by_unit(t):
    """Held-out metrics of boosted trees of its own for each unit."""
    rows = forecast.training_features(t.hours.filter("supply_kwh IS NOT NULL"))
    return learning.train_each(rows, forecast.features(t.hours), "supply_kwh", "equipment_id", "stat_hour", "boosted")[1]


@query()
def forest_forecast(t):
    """The next 24 hours of every unit by a random forest, with the covariates of the hour's profile, and a band of 1.28 RMSE of the
    unit's held-out hours (none for a unit with too few of them)."""
    model, held_out = _train(t, "forest")
    future = forecast.future_features(t.hours).na.fill(0.0, forecast.features(t.hours))
    out = learning.predict(model, future).join(held_out.select("equipment_id", "rmse"), "equipment_id", "left")
    out = forecast.band(out, "prediction", "rmse", 1.28).withColumn("confidence_lower", F.when(F.col("rmse").isNotNull(), F.col("confidence_lower")))
    return out.select("equipment_id", "target_hour", "prediction", "confidence_lower", "confidence_upper")


@query()
def forest_importances(t):
    model, _ = _train(t, "forest")
    return learning.importances(model, forecast.features(t.hours), t.spark)


# Advice

_NOW = """
    SELECT station_id, equipment_id, coalesce(avg(cooling_supply_kwh) FILTER (rn <= 6), 0) AS avg_cooling_6h, coalesce(avg(operation_rate) FILTER (rn <= 6), 0) AS operation_rate, avg(avg_supply_temp) FILTER (rn <= 6) AS avg_supply_temp, avg(avg_return_temp) FILTER (rn <= 6) AS avg_return_temp,
           max((coalesce(operation_rate, 0) > 0)::INT) FILTER (rn = 1) AS run_flag, coalesce(max(start_count) - min(start_count), 0) AS start_count_24h, count(*) FILTER (coalesce(operation_rate, 0) >= 95) AS high_load_hours
    FROM (SELECT *, row_number() OVER (PARTITION BY station_id, equipment_id ORDER BY stat_hour DESC) AS rn FROM hours) WHERE rn <= 24 GROUP BY ALL"""


def current(t):
    daily = reports.system_report(t.hours, "day")
    return advice.current_metrics(t.hours, daily)


@query(f"SELECT *, sum(run_flag) OVER (PARTITION BY station_id) AS running_units FROM ({_NOW})", doubles="avg_cooling_6h operation_rate avg_supply_temp avg_return_temp start_count_24h", longs="run_flag running_units")
def current_metrics(t):
    return current(t).drop("avg_cop")


@query(f"SELECT equipment_id, avg(predicted_cooling_kwh) AS forecast_cooling_6h FROM ({FORECAST_SQL}) WHERE forecast_hour_offset <= 6 GROUP BY ALL", doubles="forecast_cooling_6h")
def forecast_metrics(t):
    return advice.forecast_metrics(forecast.seasonal_forecast(t.hours), ["equipment_id"])


HITS_SQL = f"""
    SELECT station_id, equipment_id, unnest(list_filter([CASE WHEN c > 0 AND f < c * 0.7 AND u >= 2 THEN 'R001' END, CASE WHEN c > 0 AND f > c * 1.3 AND u < 3 THEN 'R002' END, CASE WHEN run_flag > 0 AND (d < 3 OR d > 8) THEN 'R003' END,
           CASE WHEN avg_cop < 2.5 AND operation_rate > 50 THEN 'R004' END, CASE WHEN start_count_24h > 10 THEN 'R005' END, CASE WHEN operation_rate > 95 AND high_load_hours > 6 THEN 'R006' END], lambda x: x IS NOT NULL)) AS rule_id
    FROM (SELECT n.*, avg_cooling_6h AS c, coalesce(forecast_cooling_6h, 0) AS f, sum(run_flag) OVER (PARTITION BY station_id) AS u, avg_return_temp - avg_supply_temp AS d, avg_cop FROM ({_NOW}) n
          LEFT JOIN (SELECT equipment_id, avg(predicted_cooling_kwh) AS forecast_cooling_6h FROM ({FORECAST_SQL}) WHERE forecast_hour_offset <= 6 GROUP BY ALL) USING (equipment_id)
          LEFT JOIN (SELECT equipment_id, arg_max(cop, d) AS avg_cop FROM (SELECT equipment_id, stat_hour::DATE AS d, CASE WHEN sum(energy_consumption_kwh) > 0 THEN sum(supply_kwh) / sum(energy_consumption_kwh) END AS cop FROM hours GROUP BY ALL) GROUP BY ALL) USING (equipment_id))"""


def advised(t):
    found = current(t).join(advice.forecast_metrics(forecast.seasonal_forecast(t.hours), ["equipment_id"]), "equipment_id", "left")
    return advice.advise(found)


@query(HITS_SQL)
def advice_rules(t):
    return advised(t).select("station_id", "equipment_id", "rule_id")


@query(f"SELECT CASE WHEN rule_id IN ('R002', 'R003', 'R006') THEN 'high' ELSE 'medium' END AS risk_level, count(*) AS rows FROM ({HITS_SQL}) GROUP BY ALL")
def advice_by_risk(t):
    return advice.by_risk(advised(t))


@query()
def advice_texts(t):
    """Advice with its texts and evidence."""
    return advised(t)
