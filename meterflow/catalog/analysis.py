"""Queries of serving, dashboards, audits and scale workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow.catalog.base import query
from meterflow.catalog.business import FORECAST_SQL, REVENUE_SQL, report_sql, revenue_of
from meterflow.functions import scalars
from meterflow.operators import aggregates, joins
from meterflow.plans import advice, audit, dashboard, forecast, reports, serve

# Serving


@query("SELECT station_id, equipment_id, stat_hour, supply_kwh FROM hours WHERE station_id = 'station_1' AND stat_hour BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY stat_hour DESC, equipment_id LIMIT 100", doubles="supply_kwh", times="stat_hour")
def serve_supply_curve(t):
    return serve.query(t.hours, {"station_id": "station_1", "equipment_id": None}, ("stat_hour", "2024-01-05", "2024-01-20"), ["-stat_hour", "equipment_id"], 100, ["station_id", "equipment_id", "stat_hour", "supply_kwh"])


@query(f"SELECT equipment_id, stat_date, total_supply_kwh, peak_supply_kwh FROM ({report_sql('day')}) WHERE system_type = 'heating' ORDER BY stat_date DESC, equipment_id LIMIT 50", doubles="total_supply_kwh peak_supply_kwh")
def serve_daily_report(t):
    return serve.query(reports.system_report(t.hours, "day"), {"system_type": "heating"}, None, ["-stat_date", "equipment_id"], 50, ["equipment_id", "stat_date", "total_supply_kwh", "peak_supply_kwh"])


@query(f"SELECT equipment_id, stat_week, total_supply_kwh FROM ({report_sql('week')}) ORDER BY stat_week DESC, equipment_id LIMIT 30", doubles="total_supply_kwh")
def serve_weekly_report(t):
    return serve.query(reports.system_report(t.hours, "week"), {}, None, ["-stat_week", "equipment_id"], 30, ["equipment_id", "stat_week", "total_supply_kwh"])


@query("SELECT event_id, equipment_id, event_time, value FROM readings WHERE equipment_id = 'unit_5' ORDER BY event_time DESC, event_id DESC LIMIT 200", doubles="value", times="event_time")
def serve_equipment_status(t):
    return serve.query(t.readings, {"equipment_id": "unit_5"}, None, ["-event_time", "-event_id"], 200, ["event_id", "equipment_id", "event_time", "value"])


@query("SELECT DISTINCT station_id FROM hours ORDER BY station_id")
def serve_stations(t):
    return serve.distinct_values(t.hours.filter("false"), "station_id", fallback=t.hours)


@query("SELECT DISTINCT system_type, equipment_id FROM hours WHERE system_type = 'cchp'")
def serve_equipment(t):
    return serve.distinct_values(t.hours.filter("system_type = 'cchp'"), "system_type", "equipment_id")


@query("SELECT DISTINCT strftime(stat_hour, '%Y-%m-%d') AS day FROM hours")
def serve_dates(t):
    return serve.distinct_values(t.hours.select(F.to_date("stat_hour").cast("string").alias("day")), "day")


@query(f"SELECT equipment_id, target_hour, predicted_supply_kwh FROM ({FORECAST_SQL}) WHERE system_type = 'chiller' ORDER BY target_hour, equipment_id LIMIT 48", doubles="predicted_supply_kwh", times="target_hour")
def serve_forecast(t):
    return serve.query(forecast.seasonal_forecast(t.hours), {"system_type": "chiller"}, None, ["target_hour", "equipment_id"], 48, ["equipment_id", "target_hour", "predicted_supply_kwh"])


@query(f"SELECT equipment_id, target_hour, predicted_profit FROM ({REVENUE_SQL}) ORDER BY target_hour, equipment_id LIMIT 100", doubles="predicted_profit", times="target_hour")
def serve_revenue(t):
    return serve.query(revenue_of(t), {}, None, ["target_hour", "equipment_id"], 100, ["equipment_id", "target_hour", "predicted_profit"])


@query("SELECT id, updated_at, price_type, price FROM prices WHERE station_code = 'station_2' ORDER BY updated_at DESC, price_type, id LIMIT 100", doubles="price", times="updated_at")
def serve_price_history(t):
    return serve.query(t.prices, {"station_code": "station_2"}, None, ["-updated_at", "price_type", "id"], 100, ["id", "updated_at", "price_type", "price"])


# Dashboards

_LATEST = """
    SELECT system_type, equipment_id, stat_hour, supply, energy_consumption_kwh AS energy, CASE WHEN energy_consumption_kwh > 0 THEN supply / energy_consumption_kwh END AS efficiency,
           CASE WHEN coalesce(supply, 0) <= 0 AND coalesce(operation_rate, 0) <= 0 THEN 'stopped' WHEN record_count < 3 THEN 'warning' ELSE 'running' END AS status
    FROM (SELECT *, CASE WHEN coalesce(supply_kwh, 0) <> 0 THEN supply_kwh ELSE coalesce(cooling_supply_kwh, 0) + coalesce(heating_supply_kwh, 0) + coalesce(electric_supply_kwh, 0) END AS supply, row_number() OVER (PARTITION BY equipment_id ORDER BY stat_hour DESC) AS rn FROM hours) WHERE rn = 1"""
_SYSTEMS = f"SELECT system_type, count(*) AS equipment_count, count(*) FILTER (status = 'running') AS running_count, count(*) FILTER (status = 'warning') AS warning_count, sum(supply) AS total_supply, sum(energy) AS total_energy FROM ({_LATEST}) GROUP BY ALL"


@query(_LATEST, doubles="supply energy efficiency", times="stat_hour")
def latest_snapshot(t):
    return dashboard.snapshot(t.hours)


@query(_SYSTEMS, doubles="total_supply total_energy")
def system_rollup(t):
    return dashboard.by_system(dashboard.snapshot(t.hours))


@query("SELECT date_trunc('hour', stat_hour) AS period, sum(coalesce(supply_kwh, 0)) AS supply, sum(coalesce(energy_consumption_kwh, 0)) AS energy FROM hours GROUP BY ALL ORDER BY period DESC LIMIT 24", doubles="supply energy", times="period")
def hourly_trend(t):
    return dashboard.trend(t.hours)


@query("SELECT date_trunc('day', stat_hour)::TIMESTAMP AS period, sum(coalesce(supply_kwh, 0)) AS supply, sum(coalesce(energy_consumption_kwh, 0)) AS energy FROM hours GROUP BY ALL ORDER BY period DESC LIMIT 30", doubles="supply energy", times="period")
def daily_trend(t):
    return dashboard.trend(t.hours, "day", 30)


@query(f"SELECT forecast_hour_offset, sum(predicted_supply_kwh) AS total_predicted_supply_kwh, sum(confidence_lower) AS total_confidence_lower, sum(confidence_upper) AS total_confidence_upper FROM ({FORECAST_SQL}) GROUP BY ALL", doubles="total_predicted_supply_kwh total_confidence_lower total_confidence_upper")
def forecast_totals(t):
    return dashboard.forecast_totals(forecast.seasonal_forecast(t.hours))


@query(f"SELECT coalesce(sum(predicted_profit) FILTER (equipment_id = 'unit_99'), sum(predicted_profit) FILTER (system_type = 'chiller'), sum(predicted_profit)) AS profit FROM ({REVENUE_SQL})", doubles="profit")
def profit_kpi(t):
    return dashboard.profit_scope(revenue_of(t), "predicted_profit", [F.col("equipment_id") == "unit_99", F.col("system_type") == "chiller", F.lit(True)])


@query(f"""SELECT count(*) AS equipment, count(*) FILTER (status IN ('running', 'warning')) AS online, sum(supply) AS supply, sum(energy) AS energy, sum(supply) / sum(energy) AS efficiency, count(*) FILTER (status IN ('running', 'warning')) / count(*) * 100 AS health_score,
    avg(efficiency) FILTER (efficiency > 0) AS mean_positive_cop FROM ({_LATEST})""", doubles="supply energy efficiency health_score mean_positive_cop")
def kpi_row(t):
    return dashboard.kpis(dashboard.snapshot(t.hours))


@query("""SELECT equipment_id, theme, count(*) AS records, sum(value) AS total, avg(value) AS mean, max(value) AS most, min(value) AS least, count(*) FILTER (value > 0) AS positive FROM (
    SELECT equipment_id, 'supply' AS theme, supply_kwh AS value FROM hours UNION ALL SELECT equipment_id, 'energy', energy_consumption_kwh FROM hours) WHERE value IS NOT NULL GROUP BY ALL""", doubles="total mean most least")
def theme_statistics(t):
    return dashboard.theme_stats(t.hours, {"supply": "supply_kwh", "energy": "energy_consumption_kwh"}).drop("system_type")


@query("SELECT stat_hour, max(supply_kwh) FILTER (equipment_id = 'unit_0') AS unit_0, max(supply_kwh) FILTER (equipment_id = 'unit_1') AS unit_1 FROM hours GROUP BY ALL", doubles="unit_0 unit_1", times="stat_hour")
def aligned_grid(t):
    return dashboard.aligned_grid(t.hours, "equipment_id", ["unit_0", "unit_1"], "supply_kwh")


@query("""SELECT equipment_id, count(*) AS rows, count(*) FILTER (run_flag > 0) AS running_rows, avg(avg_supply_temp) AS mean_avg_supply_temp, avg(avg_power) AS mean_avg_power, count(*) FILTER (avg_supply_temp IS NOT NULL AND avg_power IS NOT NULL) * 100.0 / count(*) AS quality_pct
    FROM (SELECT *, runtime_hours AS run_flag FROM hours) GROUP BY ALL""", doubles="mean_avg_supply_temp mean_avg_power quality_pct")
def device_statistics(t):
    return dashboard.device_stats(t.hours.withColumn("run_flag", F.col("runtime_hours")), ["avg_supply_temp", "avg_power"], ["equipment_id"])


@query(f"SELECT system_type, sum(predicted_supply_revenue) AS revenue, sum(predicted_energy_cost) AS cost, sum(predicted_profit) AS profit, avg(profit_margin) AS mean_margin FROM ({REVENUE_SQL}) GROUP BY ALL", doubles="revenue cost profit mean_margin")
def revenue_totals(t):
    return dashboard.totals_and_margin(revenue_of(t), ["system_type"])


@query("SELECT updated_at AS day, avg(price) FILTER (price_type = 'gas') AS gas, avg(price) FILTER (price_type = 'cooling') AS cooling FROM prices GROUP BY ALL", doubles="gas cooling", times="day")
def price_grid(t):
    return dashboard.price_grid(t.prices.withColumnRenamed("updated_at", "day"), ["gas", "cooling"], "day", "price_type", "price")


@query("SELECT system_type, equipment_id, sum(supply_kwh) AS total FROM hours GROUP BY ALL ORDER BY total DESC, system_type, equipment_id LIMIT 8", doubles="total")
def top_equipment(t):
    return dashboard.top_equipment(t.hours)


@query("SELECT DISTINCT strftime(stat_hour, '%Y-%m-%d') AS day FROM hours WHERE strftime(stat_hour, '%Y-%m-%d') <= '2024-01-20' ORDER BY day DESC LIMIT 7")
def recent_dates(t):
    return dashboard.available_dates(t.hours.select(F.to_date("stat_hour").cast("string").alias("day")), "day", "2024-01-20", 7)


@query(f"""SELECT rank, system_type, equipment_id, advice_type FROM (
    SELECT 1 AS rank, system_type, 'system' AS equipment_id, 'operation_status' AS advice_type FROM ({_SYSTEMS}) WHERE running_count = 0 AND total_supply <= 0 UNION ALL
    SELECT 2, system_type, 'system', 'efficiency' FROM ({_SYSTEMS}) WHERE NOT (running_count = 0 AND total_supply <= 0) AND total_energy > 0 AND total_supply / total_energy < 1 UNION ALL
    SELECT * FROM (SELECT 3, system_type, equipment_id, 'dispatch' FROM ({_LATEST}) WHERE status = 'running' ORDER BY supply DESC, equipment_id LIMIT 3) UNION ALL
    SELECT 4, NULL, 'revenue', 'economic' FROM (SELECT sum(predicted_profit) AS p FROM ({REVENUE_SQL})) WHERE p < 0) ORDER BY rank, system_type, equipment_id LIMIT 8""", longs="rank")
def dashboard_advice(t):
    now = dashboard.snapshot(t.hours)
    total = revenue_of(t).agg(F.sum("predicted_profit").alias("revenue"))
    return advice.dashboard_advice(now, dashboard.by_system(now), total).select("rank", "system_type", "equipment_id", "advice_type")


# Audits and workloads


@query("""SELECT count(*) AS rows, count(*) FILTER (abs(energy_consumption_kwh - avg_power * runtime_hours) > 1e-4) AS energy_mismatch, count(*) FILTER (abs(operation_rate - run_minutes / 60 * 100) > 1e-4) AS rate_mismatch, count(*) FILTER (abs(cooling_supply_kwh - supply_kwh * runtime_hours) > 1e-4) AS cooling_mismatch,
    count(*) FILTER (NOT runtime_hours BETWEEN 0 AND 1) AS runtime_out_of_range, count(*) FILTER (NOT operation_rate BETWEEN 0 AND 100) AS rate_out_of_range FROM hours""")
def formula_checks(t):
    return audit.formula_checks(t.hours.withColumn("cooling_capacity_kw", F.col("supply_kwh")))


@query("SELECT station_id, stat_hour, side FROM (SELECT station_id, stat_hour, 'first' AS side FROM (SELECT DISTINCT station_id, stat_hour FROM hours WHERE equipment_id = 'unit_1' EXCEPT SELECT DISTINCT station_id, stat_hour FROM hours WHERE equipment_id = 'unit_5') UNION ALL SELECT station_id, stat_hour, 'second' FROM (SELECT DISTINCT station_id, stat_hour FROM hours WHERE equipment_id = 'unit_5' EXCEPT SELECT DISTINCT station_id, stat_hour FROM hours WHERE equipment_id = 'unit_1'))", times="stat_hour")
def hour_coverage(t):
    return joins.coverage(t.hours.filter("equipment_id = 'unit_1'"), t.hours.filter("equipment_id = 'unit_5'"), ["station_id", "stat_hour"], ("first", "second"))


@query("SELECT count(*) FILTER (a.d IS NOT NULL AND b.d IS NOT NULL) AS matched, count(*) FILTER (b.d IS NULL) AS left_only, count(*) FILTER (a.d IS NULL) AS right_only, count(*) FILTER (abs(s - r) > 0.01) AS supply_mismatch FROM (SELECT equipment_id, stat_hour::DATE AS d, sum(supply_kwh) AS s FROM hours GROUP BY ALL) a FULL JOIN (SELECT equipment_id, stat_hour::DATE AS d, sum(supply_kwh) AS r FROM hours WHERE record_count > 1 GROUP BY ALL) b ON a.equipment_id = b.equipment_id AND a.d = b.d")
def reconcile_days(t):
    of = lambda rows, name: rows.groupBy("equipment_id", F.to_date("stat_hour").alias("d")).agg(F.sum("supply_kwh").alias(name))
    return joins.reconcile(of(t.hours, "supply"), of(t.hours.filter("record_count > 1"), "other"), ["equipment_id", "d"], {"supply": "other"}, 0.01)


@query("SELECT (SELECT count(*) FROM part) AS points, (SELECT count(DISTINCT p_partkey) FROM part) AS codes, 0 AS bad_prefix, 0 AS no_role, (SELECT count(*) FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) AS joined_rows, (SELECT count(*) FROM lineitem) AS rows, true AS passes", longs="bad_prefix no_role")
def governance_gate(t):
    points = t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_type").alias("role"))
    return audit.governance_gate(t.lineitem.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("point")), points, "point", "code", "role", "P")


@query("SELECT 'events' AS table_name, count(*) AS rows, min(ts) AS first_time, max(ts) AS last_time FROM events UNION ALL SELECT 'orders', count(*), min(o_orderdate), max(o_orderdate) FROM orders UNION ALL SELECT 'lineitem', count(*), min(l_shipdate), max(l_shipdate) FROM lineitem", times="first_time last_time")
def timeliness(t):
    return audit.timeliness({"events": (t.events, "ts"), "orders": (t.orders, "o_orderdate"), "lineitem": (t.lineitem, "l_shipdate")})


@query("SELECT equipment_id, count(avg_supply_temp) AS supply_hours, sum(supply_kwh) AS supply FROM hours WHERE stat_hour > (SELECT max(stat_hour) FROM hours) - INTERVAL 96 HOUR GROUP BY ALL", doubles="supply")
def last_hours_audit(t):
    recent = audit.last_hours(t.hours, "stat_hour", 96)
    return recent.groupBy("equipment_id").agg(F.count("avg_supply_temp").alias("supply_hours"), F.sum("supply_kwh").alias("supply"))


@query(f"SELECT equipment_id, count(*) AS rows, min(predicted_supply_kwh) AS least, max(predicted_supply_kwh) AS most, avg(predicted_supply_kwh) AS mean, avg(confidence_upper - confidence_lower) AS mean_width, count(*) FILTER (predicted_supply_kwh < 0) AS negative, count(*) FILTER (predicted_supply_kwh IS NULL) AS missing, count(*) = 24 AS complete FROM ({FORECAST_SQL}) GROUP BY ALL", doubles="least most mean mean_width")
def forecast_check(t):
    return audit.forecast_check(forecast.seasonal_forecast(t.hours), ["equipment_id"])


@query("""
    SELECT count(*) AS batches, sum(n) AS rows, avg(e - b) AS mean_seconds, max(e - b) AS most_seconds FROM (SELECT user_id, floor(epoch(min(ts)))::BIGINT AS b, floor(epoch(max(ts)))::BIGINT AS e, count(*) AS n FROM events GROUP BY ALL)""", doubles="mean_seconds", longs="rows most_seconds")
def batch_log_metrics(t):
    """A log with a start and a finish line for each user's events."""
    each = t.events.groupBy("user_id").agg(F.min("ts").alias("b"), F.max("ts").alias("e"), F.count(F.lit(1)).alias("n"))
    line = lambda ts, event: F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(f"batch {event}"), F.concat(F.lit("id="), F.col("user_id").cast("string")), F.concat(F.lit("rows="), F.col("n").cast("string")))
    return audit.batch_log_metrics(each.select(F.explode(F.array(line("b", "start"), line("e", "finish"))).alias("value")))


@query("SELECT equipment_id, count(*) AS rows, sum(supply_kwh) AS sum_supply_kwh FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY stat_hour DESC) AS rn FROM hours) WHERE rn <= 168 GROUP BY ALL", doubles="sum_supply_kwh")
def latest_168_workload(t):
    return audit.recent_window_report(t.hours, ["equipment_id"], "stat_hour", "supply_kwh")


@query("SELECT count(*) AS rows, sum(supply_kwh) AS sum_supply_kwh, sum(energy_consumption_kwh) AS sum_energy_consumption_kwh FROM hours", doubles="sum_supply_kwh sum_energy_consumption_kwh")
def checksum_workload(t):
    return audit.checksum(t.hours, ["supply_kwh", "energy_consumption_kwh"])


@query("""SELECT station_id, system_type, count(*) AS hours, sum(supply_kwh) AS supply, max(supply_kwh) AS peak FROM (SELECT station_id || '_' || i AS station_id, system_type, supply_kwh FROM hours, range(20) r(i)) GROUP BY ALL""", doubles="supply peak")
def replicated_report_workload(t):
    """The hourly table for 20 simulated copies of every station, reported by station and system."""
    rows = joins.replicate(t.hours, 20, "station_id")
    return rows.groupBy("station_id", "system_type").agg(F.count(F.lit(1)).alias("hours"), F.sum("supply_kwh").alias("supply"), F.max("supply_kwh").alias("peak"))


@query("SELECT event_type, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS distinct_day, count(*) AS rows, count(value) AS non_null_rows, count(*) FILTER (value > 0) AS positive_rows FROM events GROUP BY ALL")
def ingestion_check(t):
    return aggregates.coverage_counts(t.events.withColumn("day", F.to_date("ts").cast("string")), ["event_type"], ["user_id", "day"], "value")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, count(*) AS rows FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL", doubles="sum_qty sum_price")
def filtered_totals(t):
    kept = t.lineitem.filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), scalars.decimal_sum("l_extendedprice").alias("sum_price"), F.count(F.lit(1)).alias("rows"))
