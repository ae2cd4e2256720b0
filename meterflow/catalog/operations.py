"""Queries of further serving tables, audits and the writers' set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow.catalog.base import query
from meterflow.catalog.business import FORECAST_SQL, HITS_SQL, REVENUE_SQL, advised, chiller_sql, quality_rows, report_sql, revenue_of, tariff_sql
from meterflow.functions.scalars import decimal_sum, safe_div
from meterflow.operators import joins
from meterflow.plans import audit, dashboard, forecast, reports, serve

# Serving


@query("SELECT system_type, equipment_id, stat_hour, supply_kwh, energy_consumption_kwh FROM hours WHERE system_type = 'cchp' AND stat_hour::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' ORDER BY stat_hour DESC, equipment_id LIMIT 1000",
       doubles="supply_kwh energy_consumption_kwh", times="stat_hour")
def serve_system_supply_curve(t):
    days = ("stat_hour", "2024-01-03", "2024-01-25 23:59:59")
    return serve.query(t.hours, {"system_type": "cchp", "station_id": None}, days, ["-stat_hour", "equipment_id"], 1000, ["system_type", "equipment_id", "stat_hour", "supply_kwh", "energy_consumption_kwh"])


@query(f"SELECT system_type, equipment_id, stat_month, total_supply_kwh, avg_cop FROM ({report_sql('month')}) WHERE system_type = 'chiller' ORDER BY stat_month DESC, equipment_id LIMIT 100", doubles="total_supply_kwh avg_cop")
def serve_monthly_report(t):
    return serve.query(reports.system_report(t.hours, "month", t.price_row), {"system_type": "chiller"}, None, ["-stat_month", "equipment_id"], 100, ["system_type", "equipment_id", "stat_month", "total_supply_kwh", "avg_cop"])


@query(f"SELECT equipment_id, target_hour AS first_hour, predicted_supply_kwh, (confidence_upper - confidence_lower) / 2 AS half_width FROM ({FORECAST_SQL}) WHERE forecast_hour_offset = 1 AND system_type = 'heating' ORDER BY equipment_id LIMIT 50", doubles="predicted_supply_kwh half_width", times="first_hour")
def serve_forecast_metrics(t):
    """Where no metrics are stored, those that the forecast itself tells."""
    made = forecast.metrics_from_forecast(forecast.seasonal_forecast(t.hours))
    return serve.query(made, {"system_type": "heating"}, None, ["equipment_id"], 50, ["equipment_id", "first_hour", "predicted_supply_kwh", "half_width"])


_NAMED = "CASE substring(equipment_id, 6)::INT % 3 WHEN 0 THEN 'chiller_' WHEN 1 THEN 'boiler_' ELSE 'generator_' END || substring(equipment_id, 6)"


@query(f"""SELECT system_type, equipment_id, rule_id, advice_time FROM (SELECT *, CASE WHEN equipment_id LIKE 'chiller%' THEN 'chiller' WHEN equipment_id LIKE 'boiler%' THEN 'heating' ELSE 'cchp' END AS system_type
    FROM (SELECT {_NAMED} AS equipment_id, rule_id, last_hour AS advice_time FROM ({HITS_SQL}) JOIN (SELECT equipment_id, max(stat_hour) AS last_hour FROM hours GROUP BY ALL) USING (equipment_id) WHERE rule_id <> 'R006'))
    WHERE system_type = 'heating' ORDER BY advice_time DESC, equipment_id, rule_id LIMIT 100""", times="advice_time")
def serve_advice(t):
    """Active advice of a system that its equipment's id tells; one rule's advice is no longer active."""
    number = F.substring("equipment_id", 6, 9)
    start = F.get(F.array(F.lit("chiller_"), F.lit("boiler_"), F.lit("generator_")), (number.cast("int") % 3))
    latest = t.hours.groupBy("equipment_id").agg(F.max("stat_hour").alias("advice_time"))
    rows = advised(t).join(latest, "equipment_id").withColumns({"equipment_id": F.concat(start, number), "is_active": F.col("rule_id") != "R006"})
    return serve.active_advice(rows, "heating").select("system_type", "equipment_id", "rule_id", "advice_time")


@query(f"SELECT equipment_id, stat_week, total_cooling_supply_kwh, net_profit FROM ({chiller_sql('week', tariff_sql('stat_hour'))}) WHERE station_id = 'station_1' ORDER BY stat_week DESC, equipment_id LIMIT 40", doubles="total_cooling_supply_kwh net_profit")
def serve_chiller_weekly(t):
    return serve.query(reports.tariff_report(t.hours, "week"), {"station_id": "station_1"}, None, ["-stat_week", "equipment_id"], 40, ["equipment_id", "stat_week", "total_cooling_supply_kwh", "net_profit"])


@query(f"SELECT equipment_id, stat_month, total_cooling_supply_kwh, net_profit FROM ({chiller_sql('month', tariff_sql('stat_hour'))}) ORDER BY stat_month DESC, equipment_id LIMIT 40", doubles="total_cooling_supply_kwh net_profit")
def serve_chiller_monthly(t):
    return serve.query(reports.tariff_report(t.hours, "month"), {"station_id": None}, None, ["-stat_month", "equipment_id"], 40, ["equipment_id", "stat_month", "total_cooling_supply_kwh", "net_profit"])


@query(f"SELECT equipment_id, target_hour, predicted_cooling_kwh, confidence_lower, confidence_upper FROM ({FORECAST_SQL}) WHERE equipment_id = 'unit_3' ORDER BY target_hour LIMIT 24", doubles="predicted_cooling_kwh confidence_lower confidence_upper", times="target_hour")
def serve_equipment_forecast(t):
    return serve.query(forecast.seasonal_forecast(t.hours), {"equipment_id": "unit_3"}, None, ["target_hour"], 24, ["equipment_id", "target_hour", "predicted_cooling_kwh", "confidence_lower", "confidence_upper"])


@query(f"SELECT equipment_id, target_hour, predicted_cooling_kwh * 0.3 AS predicted_revenue, predicted_cooling_kwh * 0.3 - predicted_cooling_kwh / 3.5 * {tariff_sql('target_hour')} AS predicted_profit FROM ({FORECAST_SQL}) ORDER BY target_hour, equipment_id LIMIT 100", doubles="predicted_revenue predicted_profit", times="target_hour")
def serve_cooling_revenue(t):
    return serve.query(forecast.cooling_revenue(forecast.seasonal_forecast(t.hours)), {}, None, ["target_hour", "equipment_id"], 100, ["equipment_id", "target_hour", "predicted_revenue", "predicted_profit"])


@query("""SELECT equipment_id, day, hour_count FROM (SELECT equipment_id, strftime(stat_hour, '%Y-%m-%d') AS day, count(*) AS hour_count, 0.4 * least(count(*) / 24.0, 1.0) + 0.6 * (CASE WHEN count(*) FILTER (supply_kwh > 0) > 0
        THEN (count(*) FILTER (supply_kwh > 0 AND avg_supply_temp IS NOT NULL) + count(*) FILTER (supply_kwh > 0 AND avg_power IS NOT NULL)) / 2 / count(*) FILTER (supply_kwh > 0) ELSE 1.0 END) AS score FROM hours GROUP BY ALL)
    WHERE score < 0.6 ORDER BY day DESC, equipment_id LIMIT 200""")
def serve_data_quality(t):
    """Days of poor quality, latest first."""
    return serve.query(quality_rows(t), {"quality_flag": "poor"}, None, ["-day", "equipment_id"], 200, ["equipment_id", "day", "hour_count"])


@query("""
    SELECT equipment_id, stat_hour, CASE WHEN record_count = 0 THEN 'nodata' WHEN idle THEN 'stopped' WHEN record_count < 3 THEN 'warning' ELSE 'running' END AS status,
           CASE WHEN record_count = 0 THEN 'nodata' WHEN idle THEN 'stopped' WHEN record_count < 3 OR coalesce(cop < 0.5, false) THEN 'warning' ELSE 'running' END AS status_by_cop
    FROM (SELECT *, coalesce(supply_kwh, 0) <= 0 AND coalesce(operation_rate, 0) <= 0 AS idle, CASE WHEN energy_consumption_kwh > 0 THEN supply_kwh / energy_consumption_kwh END AS cop FROM hours)""", times="stat_hour")
def unit_status(t):
    """Every hour's status, told with and without the efficiency."""
    hours = t.hours.withColumn("cop", safe_div("supply_kwh", "energy_consumption_kwh"))
    plain = dashboard.status("record_count", "supply_kwh", "operation_rate")
    return hours.select("equipment_id", "stat_hour", plain.alias("status"), dashboard.status("record_count", "supply_kwh", "operation_rate", "cop").alias("status_by_cop"))


# Audits


@query(f"""
    WITH f AS (SELECT system_type, equipment_id, target_hour, forecast_hour_offset AS o, predicted_cooling_kwh AS c, predicted_heating_kwh AS h, predicted_electric_kwh AS e, predicted_energy_kwh AS n FROM ({FORECAST_SQL})),
         p AS (SELECT * FROM price_row)
    SELECT count(*) FILTER (o % 7 = 2) AS missing_forecast, count(*) FILTER (o % 7 = 3) AS missing_revenue, count(*) FILTER (o % 7 NOT IN (2, 3) AND o % 5 = 0) AS cooling_mismatch, 0 AS heating_mismatch, 0 AS electric_mismatch,
           0 AS cost_mismatch, count(*) FILTER (o % 7 <> 3 AND o % 5 = 0 AND cooling_price > 0.0001) AS revenue_mismatch, count(*) FILTER (o % 7 <> 3 AND o % 4 = 0) AS profit_mismatch, count(*) FILTER (o % 7 <> 3 AND n < 0) AS negative_cost,
           count(*) FILTER (o % 7 = 3) AS missing_profit FROM f, p""", longs="heating_mismatch electric_mismatch cost_mismatch")
def revenue_reconciliation(t):
    """Of forecast and revenue each lacks some hours; some amounts and profits have been changed."""
    ahead, offset = forecast.seasonal_forecast(t.hours), F.col("forecast_hour_offset")
    paid = revenue_of(t).filter(offset % 7 != 3)
    paid = paid.withColumn("predicted_cooling_kwh", F.when(offset % 5 == 0, F.col("predicted_cooling_kwh") + 1).otherwise(F.col("predicted_cooling_kwh")))
    paid = paid.withColumn("predicted_profit", F.when(offset % 4 == 0, F.col("predicted_profit") - 1).otherwise(F.col("predicted_profit")))
    return audit.revenue_reconciliation(ahead.filter(offset % 7 != 2), paid, ["system_type", "equipment_id", "target_hour"], {"cooling": "cooling_price", "heating": "heating_price", "electric": "electricity_price"})


@query("""SELECT field, rows, nulls, nulls = 0 AS passes FROM (SELECT count(*) AS rows, count(*) - count(value) AS value, count(*) - count(measure_role) AS measure_role, count(*) FILTER (theme IS NULL) AS theme FROM readings)
    UNPIVOT INCLUDE NULLS (nulls FOR field IN (value, measure_role, theme))""")
def required_fields(t):
    return audit.required_fields(t.readings, ["value", "measure_role", "theme"])


@query(f"""SELECT field, rows, nulls, nulls = 0 AS passes FROM (SELECT count(*) AS rows, count(*) - count(rule_id) AS rule_id, count(*) - count(equipment_id) AS equipment_id FROM ({HITS_SQL})) UNPIVOT INCLUDE NULLS (nulls FOR field IN (rule_id, equipment_id))
    UNION ALL SELECT unnest(['advice_text', 'evidence_metrics']), (SELECT count(*) FROM ({HITS_SQL})), 0, true""")
def advice_fields(t):
    """Every advice has what it must have."""
    return audit.required_fields(advised(t), ["rule_id", "equipment_id", "advice_text", "evidence_metrics"])


@query(f"""
    SELECT * FROM (SELECT equipment_id, count(*) AS hours, sum(coalesce(supply_kwh, 0)) AS supply, count(*) FILTER (supply_kwh > 0) AS positive, avg(operation_rate) AS operation_rate, max(stat_hour) AS last_hour FROM hours WHERE system_type = 'heating' GROUP BY ALL)
    LEFT JOIN (SELECT equipment_id, count(*) AS hours_recent, sum(coalesce(supply_kwh, 0)) AS supply_recent, count(*) FILTER (supply_kwh > 0) AS positive_recent, avg(operation_rate) AS operation_rate_recent
               FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY stat_hour DESC) AS rn FROM hours) WHERE rn <= 96 GROUP BY ALL) USING (equipment_id)
    LEFT JOIN (SELECT equipment_id, count(*) AS forecast_hours, sum(predicted_supply_kwh) AS predicted_supply, count(*) FILTER (predicted_supply_kwh > 0) AS positive_forecast FROM ({FORECAST_SQL}) GROUP BY ALL) USING (equipment_id)
    LEFT JOIN (SELECT equipment_id, sum(predicted_supply_revenue) AS predicted_revenue, sum(predicted_profit) AS predicted_profit FROM ({REVENUE_SQL}) GROUP BY ALL) USING (equipment_id)""",
       doubles="supply operation_rate supply_recent operation_rate_recent predicted_supply predicted_revenue predicted_profit", times="last_hour")
def heating_zero_forecast(t):
    heating = lambda df: df.filter("system_type = 'heating'")
    return audit.zero_forecast(heating(t.hours), heating(forecast.seasonal_forecast(t.hours)), heating(revenue_of(t)))


@query("""
    SELECT 'readings' AS table_name, unnest(['rows', 'least_event_time', 'most_event_time', 'distinct_point_code']) AS statistic,
           unnest([count(*)::VARCHAR, strftime(min(event_time), '%Y-%m-%d %H:%M:%S'), strftime(max(event_time), '%Y-%m-%d %H:%M:%S'), count(DISTINCT point_code)::VARCHAR]) AS figure FROM readings
    UNION ALL SELECT 'hours', unnest(['rows', 'least_stat_hour', 'most_stat_hour', 'total_supply_kwh']), unnest([count(*)::VARCHAR, strftime(min(stat_hour), '%Y-%m-%d %H:%M:%S'), strftime(max(stat_hour), '%Y-%m-%d %H:%M:%S'), printf('%.2f', sum(supply_kwh::DECIMAL(18,2))::DOUBLE)]) FROM hours
    UNION ALL SELECT 'orders', 'rows', count(*)::VARCHAR FROM orders""")
def lake_statistics(t):
    tables = {"readings": t.readings, "hours": t.hours, "orders": t.orders}
    return audit.lake_statistics(tables, ["event_time", "stat_hour"], ["point_code"], ["supply_kwh"], total=decimal_sum)


@query("""
    WITH p AS (SELECT CASE WHEN p_partkey % 40 = 0 THEN 'Q' ELSE 'P' END || CASE WHEN p_partkey % 25 = 1 THEN p_partkey - 1 ELSE p_partkey END AS code, CASE WHEN p_partkey % 30 <> 0 THEN p_type END AS role FROM part)
    SELECT *, points = codes AND bad_prefix = 0 AND no_role = 0 AND rows = joined_rows AS passes FROM (
        SELECT count(*) AS points, count(DISTINCT code) AS codes, count(*) FILTER (NOT code LIKE 'P%') AS bad_prefix, count(*) - count(role) AS no_role,
               (SELECT count(*) FROM lineitem LEFT JOIN p ON 'P' || l_partkey = p.code) AS joined_rows, (SELECT count(*) FROM lineitem) AS rows FROM p)""")
def governance_gate_fails(t):
    """A dictionary with repeated codes, a foreign prefix and missing roles."""
    key = F.col("p_partkey")
    code = F.concat(F.when(key % 40 == 0, "Q").otherwise("P"), F.when(key % 25 == 1, key - 1).otherwise(key).cast("string"))
    points = t.part.select(code.alias("code"), F.when(key % 30 != 0, F.col("p_type")).alias("role"))
    return audit.governance_gate(t.lineitem.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("point")), points, "point", "code", "role", "P")


# The workloads of the published benchmark, over 20 copies of every station

COPIES = 20
ENTITY = ["station_id", "system_type", "equipment_id"]
_COPIES = f"(SELECT h.* REPLACE (station_id || '_' || i AS station_id) FROM hours h, range({COPIES}) r(i))"


def copied(hours, copies: int = COPIES):
    return joins.replicate(hours, copies, "station_id")


@query(f"""SELECT count(*) AS output_rows, sum(supply) AS supply_checksum, sum(energy) AS energy_checksum, max(peak) AS peak, max(rate) AS rate FROM (SELECT station_id, system_type, equipment_id, stat_hour::DATE AS d, max(supply_kwh) AS peak, sum(supply_kwh) AS supply,
    sum(energy_consumption_kwh) AS energy, avg(operation_rate) AS rate FROM {_COPIES} GROUP BY ALL)""", doubles="supply_checksum energy_checksum peak rate")  # fmt: skip
def scaled_report_workload(t):
    return audit.report_workload(copied(t.hours), ENTITY)


@query(f"""SELECT count(*) AS output_rows, sum(n) AS latest_hours, sum(s) AS supply_checksum FROM (SELECT station_id, system_type, equipment_id, count(*) AS n, sum(supply_kwh) AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY station_id, system_type, equipment_id ORDER BY stat_hour DESC) AS rn FROM {_COPIES}) WHERE rn <= 168 GROUP BY ALL)""", doubles="supply_checksum", longs="latest_hours")  # fmt: skip
def scaled_latest_workload(t):
    return audit.latest_workload(copied(t.hours), ENTITY)


@query(f"""SELECT count(*) AS output_rows, count(l) AS lagged_rows, avg(a) AS rolling_checksum, max(m) AS most FROM (SELECT lag(supply_kwh, 24) OVER w AS l, avg(supply_kwh) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS a, max(supply_kwh) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m
    FROM {_COPIES} WINDOW w AS (PARTITION BY station_id, system_type, equipment_id ORDER BY stat_hour)) WHERE a IS NOT NULL""", doubles="rolling_checksum most")  # fmt: skip
def scaled_feature_workload(t):
    return audit.feature_workload(copied(t.hours), ENTITY)
