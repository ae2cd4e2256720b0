"""Queries of the silver and hourly builds: events stand for readings of one plant's measuring points.

Every event gives two readings: one of the chiller's points and one of the others, so that units have several readings in a minute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.catalog.base import CTES, Tables, query
from meterflow.functions import classify
from meterflow.plans import hourly, silver
from meterflow.sources.schemas import HOURLY
from meterflow.sources.sinks import Lake, scratch_folder
from meterflow.streaming.propagate import Chain

#: Codes and names of the points, and what the rules make of them: system, equipment, theme, role.
CHILLER_POINTS = [
    ("L1_LDSCS_T", "1#站1#冷机出水温度", "chiller", "chiller_1", "temperature", "supply_temp"),
    ("L1_LDSHS_T", "1#站1#冷机回水温度", "chiller", "chiller_1", "temperature", "return_temp"),
    ("L1_F", "1#站1#冷机流量", "chiller", "chiller_1", "flow", "flow"),
    ("L1_RUN", "1#站1#冷机运行状态", "chiller", "chiller_1", "status", "status"),
    ("L1_HOURS", "1#站1#冷机运行时间", "chiller", "chiller_1", "status", "status"),
    ("L1_STARTS", "1#站1#冷机启动次数", "chiller", "chiller_1", "count", "count"),
    ("L_HEADER", "1#站冷水总管压力", "chiller", "chiller_header", "pressure", "pressure"),
    ("L1_Power", "1#站1#冷机", "chiller", "chiller_1", "power", "power"),
]
OTHER_POINTS = [
    ("Burner_Load_1", "1#站1#燃烧机负荷", "burner", "burner_1", "load", None),
    ("Op_Burner_1", "1#站1#燃烧机运行", "burner", "burner_1", "status", "status"),
    ("BetrStdB_1", "1#站1#燃烧机累计", "burner", "burner_1", "cumulative", None),
    ("Burner_Load_2", "1#站2#燃烧机负荷", "burner", "burner_2", "load", None),
    ("Boiler_Temp1", "1#站1#锅炉出水温度", "boiler", "boiler_1", "temperature", "supply_temp"),
    ("Boiler_Temp2", "1#站1#锅炉回水温度", "boiler", "boiler_1", "temperature", "return_temp"),
    ("14BOILER_GAS_TOTAL", "1#站1#锅炉燃气", "boiler", "boiler_1", "temperature", None),
    ("23BOILER_GAS_TOTAL", "1#站2#锅炉燃气", "boiler", "boiler_2", "temperature", None),
    ("Boiler_Press2", "1#站2#锅炉", "boiler", "boiler_2", "pressure", "pressure"),
    ("FT2005_RL_C", "1#站三联供热量累计", "cchp", "FT2005_RL_C", "cumulative", None),
    ("P9_ADDH", "1#站三联供冷量", "cchp", "P9_ADDH", "cumulative", None),
    ("TT2005_T", "1#站三联供供水温度", "cchp", "TT2005_T", "temperature", "supply_temp"),
    ("TT2004_T", "1#站三联供", "cchp", "TT2004_T", "temperature", None),
    ("SLG_JZ1_DD_YG_ZZ1", "1#站1#机组电能", "generator", "SLG_JZ1_DD_YG_ZZ1", "cumulative", None),
    ("1FDJ_RUN", "1#站1#发电机", "generator", "generator_1", "status", "status"),
    ("FDJ_GAS_TOTAL", "1#站燃气总量", "generator", "FDJ_GAS_TOTAL", "temperature", None),
    ("Op_Burner_2", "1#站2#燃烧机运行", "burner", "burner_2", "status", "status"),
]
POINTS = CHILLER_POINTS + OTHER_POINTS
#: Numbers of the points that are meters, which grow and now and then start again, and of those that tell whether a unit runs.
METERS, STATUS = [4, 5, 10, 14, 15, 17, 18, 21, 23], [3, 9, 22, 24]
#: Seconds of events in a second of the hourly builds, users of a station, and every how many events one comes from a point that nobody knows.
PACE, USERS, UNKNOWN = 12, 50, 40
#: Every how many events a meter's reading jumps, and by how much at least: to above and below each of the largest plausible advances.
JUMP_EVERY, JUMP = 23, 150_000
START = "2024-01-01 00:00:00"

_CODES = ", ".join(f"'{p[0]}'" for p in POINTS)


def _readings(t: Tables) -> DataFrame:
    """(event_id, n, sensor_id, timestamp, value, station, at): n numbers the point; at is the time of the hourly builds."""
    numbers = F.array(F.col("event_id") % len(CHILLER_POINTS), len(CHILLER_POINTS) + F.col("event_id") % len(OTHER_POINTS)).cast("array<int>")
    rows = t.events.withColumn("n", F.explode(numbers))
    jump = F.when(F.col("event_id") % JUMP_EVERY == 5, (F.col("event_id") % 4 + 1) * JUMP).otherwise(0)
    meter, status = F.pmod("event_id", F.lit(4000)) * 0.5 + jump, F.when(F.col("event_type") == "signup", 0.0).when(F.col("event_type") == "error", -1.0).otherwise(1.0)
    value = F.when(F.col("n").isin(*METERS), meter).when(F.col("n").isin(*STATUS), status).otherwise(F.col("value"))
    seconds = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(START))) / PACE)
    return rows.select(
        "event_id", "n", F.when(F.col("event_id") % UNKNOWN != 0, F.get(F.array(*[F.lit(p[0]) for p in POINTS]), F.col("n"))).otherwise("GHOST").alias("sensor_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.when(F.col("event_id") % 11 != 0, value).alias("value"),
        F.concat(F.lit("station_"), F.floor(F.col("user_id") / USERS).cast("string")).alias("station"), F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + seconds).alias("at"),
    )


def _points(t: Tables) -> DataFrame:
    """The dictionary: a point for each nation, twice, as dictionaries have repeated codes; classified by the rules."""
    pick = lambda i: F.get(F.array(*[F.lit(p[i]) for p in POINTS]), F.col("n_nationkey"))
    rows = t.nation.filter(F.col("n_nationkey") < len(POINTS)).select(pick(0).alias("point_code"), pick(1).alias("point_name"))
    return classify.classify_points(rows.unionByName(rows))


def _fact(t: Tables) -> DataFrame:
    """The fact table of the hourly builds, a station for every so many users."""
    known = _points(t).drop("station_id").dropDuplicates(["point_code"])
    rows = _readings(t).filter("sensor_id <> 'GHOST'").join(known.withColumnRenamed("point_code", "sensor_id"), "sensor_id")
    return rows.drop("timestamp").withColumnsRenamed({"sensor_id": "point_code", "station": "station_id", "at": "event_time"}).withColumn("dt", F.to_date("event_time"))


_VALUE = f"CASE WHEN n IN ({', '.join(map(str, METERS))}) THEN (event_id % 4000) * 0.5 + CASE WHEN event_id % {JUMP_EVERY} = 5 THEN (event_id % 4 + 1) * {JUMP} ELSE 0 END WHEN n IN ({', '.join(map(str, STATUS))}) THEN CASE event_type WHEN 'signup' THEN 0.0 WHEN 'error' THEN -1.0 ELSE 1.0 END ELSE value END"
_ROWS = ",\n        ".join(f"({i}, '{p[0]}', '{p[1]}', '{p[2]}', '{p[3]}', '{p[4]}', {repr(p[5]) if p[5] else 'NULL'})" for i, p in enumerate(POINTS))
_UNITS = "CASE theme WHEN 'temperature' THEN '℃' WHEN 'power' THEN 'kW' WHEN 'pressure' THEN 'MPa' WHEN 'flow' THEN 'm³/h' WHEN 'status' THEN 'bool' WHEN 'cumulative' THEN 'kWh' WHEN 'count' THEN 'times' WHEN 'load' THEN '%' END"
CTES |= {
    "plant": f"SELECT * FROM (VALUES {_ROWS}) AS p(n, point_code, point_name, system_type, equipment_id, theme, measure_role)",
    "plant_readings": f"""SELECT event_id, n, CASE WHEN event_id % {UNKNOWN} <> 0 THEN [{_CODES}][n + 1] ELSE 'GHOST' END AS point_code, ts,
        CASE WHEN event_id % 11 <> 0 THEN {_VALUE} END AS value, 'station_' || (user_id // {USERS}) AS station_id,
        TIMESTAMP '{START}' + to_seconds(((floor(epoch(ts))::BIGINT - epoch(TIMESTAMP '{START}')::BIGINT) // {PACE})::BIGINT) AS event_time
        FROM (SELECT *, unnest([event_id % {len(CHILLER_POINTS)}, {len(CHILLER_POINTS)} + event_id % {len(OTHER_POINTS)}]) AS n FROM events)""",
    "plant_fact": """SELECT r.*, p.* EXCLUDE (n, point_code), date_trunc('hour', event_time) AS stat_hour, event_time::DATE AS dt,
        CASE WHEN value >= 0 THEN value END AS v FROM plant_readings r JOIN plant p ON p.point_code = r.point_code""",
    "plant_minutes": """
        SELECT u.* EXCLUDE (measured_power, unit_pressure), coalesce(unit_pressure, header) AS pressure,
               CASE WHEN measured_power IS NOT NULL THEN measured_power WHEN run_flag > 0 AND flow > 0 AND return_temp - supply_temp > 0 THEN 1.163 * flow * (return_temp - supply_temp) / 3.0 END AS power
        FROM (SELECT station_id, equipment_id, date_trunc('minute', event_time) AS stat_minute, dt, max(value) FILTER (measure_role = 'supply_temp') AS supply_temp,
                     max(value) FILTER (measure_role = 'return_temp') AS return_temp, max(value) FILTER (measure_role = 'pressure') AS unit_pressure, max(value) FILTER (measure_role = 'flow') AS flow,
                     max(value) FILTER (measure_role = 'power') AS measured_power, max(value) FILTER (theme = 'status' AND point_name LIKE '%运行时间%') AS runtime_hours, max(value) FILTER (theme = 'count') AS start_count,
                     max(value) FILTER (theme = 'status' AND point_name NOT LIKE '%运行时间%') AS run_flag, count(*) AS record_count
              FROM plant_fact WHERE system_type = 'chiller' AND equipment_id <> 'chiller_header' GROUP BY ALL) u
        LEFT JOIN (SELECT station_id, date_trunc('minute', event_time) AS stat_minute, max(value) AS header FROM plant_fact
                   WHERE equipment_id = 'chiller_header' AND measure_role = 'pressure' GROUP BY ALL) h USING (station_id, stat_minute)""",
    "plant_curve": """
        SELECT *, CASE WHEN runtime_hours <= 0 THEN 0.0 ELSE cooling_capacity_kw * runtime_hours END AS cooling_supply_kwh FROM (
        SELECT *, runtime_hours * 60 AS run_minutes, runtime_hours * 100 AS operation_rate, CASE WHEN runtime_hours <= 0 THEN 0.0 ELSE avg_power * runtime_hours END AS energy_consumption_kwh,
               CASE WHEN runtime_hours <= 0 THEN 0.0 WHEN avg_flow IS NOT NULL AND avg_return_temp - avg_supply_temp > 0 THEN 1.163 * avg_flow * (avg_return_temp - avg_supply_temp) ELSE avg_power * 3.0 END AS cooling_capacity_kw
        FROM (SELECT station_id, equipment_id, date_trunc('hour', stat_minute) AS stat_hour, dt, avg(supply_temp) AS avg_supply_temp, max(supply_temp) AS max_supply_temp, min(supply_temp) AS min_supply_temp, avg(return_temp) AS avg_return_temp,
                     avg(pressure) AS avg_pressure, max(pressure) AS max_pressure, min(pressure) AS min_pressure, avg(flow) AS avg_flow, max(flow) AS max_flow, min(flow) AS min_flow, avg(power) AS avg_power, max(power) AS max_power, min(power) AS min_power,
                     max(runtime_hours) AS cumulative_runtime_hours, max(start_count) AS start_count, count(*) FILTER (run_flag > 0) AS running_sample_count, count(*) AS record_count, count(*) FILTER (run_flag > 0) / count(*) AS runtime_hours
              FROM plant_minutes GROUP BY ALL))""",
    "plant_advances": """
        SELECT *, CASE WHEN reading - lag(reading) OVER w >= 0 THEN reading - lag(reading) OVER w END AS advance
        FROM (SELECT station_id, system_type, point_code, stat_hour, max(v) AS reading FROM plant_fact GROUP BY ALL) WINDOW w AS (PARTITION BY station_id, point_code ORDER BY stat_hour)""",
    "plant_heating": """
        SELECT station_id, 'heating' AS system_type, 'heating_' || number AS equipment_id, stat_hour, avg_supply_temp, max_supply_temp, min_supply_temp, avg_return_temp, avg_pressure, max_pressure, min_pressure, avg_flow, max_flow, min_flow,
               NULL::DOUBLE AS avg_power, NULL::DOUBLE AS max_power, NULL::DOUBLE AS min_power, input AS energy_consumption_kwh, input AS energy_input_kwh, NULL::DOUBLE AS cooling_capacity_kw, supply AS supply_kwh, 0.0 AS cooling_supply_kwh, supply AS heating_supply_kwh, 0.0 AS electric_supply_kwh,
               runtime_hours, cumulative_runtime_hours, NULL::DOUBLE AS start_count, running_sample_count, runtime_hours * 60 AS run_minutes, runtime_hours * 100 AS operation_rate, burner_records + coalesce(boiler_records, 0) AS record_count, 'heating' AS supply_price_type,
               CASE WHEN advance IS NULL THEN 'load_estimated' WHEN group_weight > 0 THEN 'gas_delta_allocated_by_load' ELSE 'gas_delta_equal_allocated' END AS metric_quality, stat_hour::DATE AS dt
        FROM (SELECT *, CASE WHEN advance IS NOT NULL THEN advance * 9.7 * share WHEN runtime_hours > 0 THEN supply / 0.9 ELSE 0.0 END AS input
              FROM (SELECT *, CASE WHEN advance IS NOT NULL THEN advance * 9.7 * 0.9 * share WHEN runtime_hours > 0 THEN coalesce(load_pct, 0.0) / 100 * 1000 * runtime_hours ELSE 0.0 END AS supply
                    FROM (SELECT *, CASE WHEN group_weight > 0 THEN weight / group_weight ELSE 1.0 / members END AS share
                          FROM (SELECT *, sum(weight) OVER (PARTITION BY station_id, gas_group, stat_hour) AS group_weight, count(*) OVER (PARTITION BY station_id, gas_group, stat_hour) AS members
                                FROM (SELECT *, CASE WHEN runtime_hours > 0 AND load_pct > 0 THEN runtime_hours * load_pct WHEN runtime_hours > 0 THEN runtime_hours ELSE 0.0 END AS weight, CASE WHEN number IN ('1', '4') THEN '14' ELSE '23' END AS gas_group
                                      FROM (SELECT *, coalesce(measured, CASE WHEN load_pct > 0 THEN least(load_pct / 100.0, 1.0) ELSE 0.0 END) AS runtime_hours
                                            FROM (SELECT station_id, regexp_extract(equipment_id, '([0-9]+)$', 1) AS number, stat_hour, avg(v) FILTER (point_code LIKE 'Burner_Load_%' AND v BETWEEN 0 AND 120) AS load_pct,
                                                         avg(v) FILTER (point_code LIKE 'Op_Burner_%' AND v BETWEEN 0 AND 1) AS measured, count(*) FILTER (point_code LIKE 'Op_Burner_%' AND v > 0) AS running_sample_count,
                                                         max(v) FILTER (point_code LIKE 'BetrStdB_%') AS cumulative_runtime_hours, count(*) AS burner_records
                                                  FROM plant_fact WHERE system_type = 'burner' AND regexp_matches(equipment_id, '^burner_[0-9]+$') GROUP BY ALL)))))
                    LEFT JOIN (SELECT station_id, stat_hour, CASE point_code WHEN '14BOILER_GAS_TOTAL' THEN '14' ELSE '23' END AS gas_group, CASE WHEN advance <= 200000 THEN advance END AS advance
                               FROM plant_advances WHERE system_type = 'boiler' AND point_code IN ('14BOILER_GAS_TOTAL', '23BOILER_GAS_TOTAL')) USING (station_id, gas_group, stat_hour)
                    LEFT JOIN (SELECT station_id, regexp_extract(equipment_id, '([0-9]+)$', 1) AS number, stat_hour, avg(v) FILTER (measure_role = 'supply_temp' AND v BETWEEN 0 AND 120) AS avg_supply_temp,
                                      max(v) FILTER (measure_role = 'supply_temp' AND v BETWEEN 0 AND 120) AS max_supply_temp, min(v) FILTER (measure_role = 'supply_temp' AND v BETWEEN 0 AND 120) AS min_supply_temp, avg(v) FILTER (measure_role = 'return_temp' AND v BETWEEN 0 AND 120) AS avg_return_temp,
                                      avg(v) FILTER (measure_role = 'pressure' AND v BETWEEN 0 AND 10) AS avg_pressure, max(v) FILTER (measure_role = 'pressure' AND v BETWEEN 0 AND 10) AS max_pressure, min(v) FILTER (measure_role = 'pressure' AND v BETWEEN 0 AND 10) AS min_pressure,
                                      avg(v) FILTER (measure_role = 'flow' AND v BETWEEN 0 AND 100000) AS avg_flow, max(v) FILTER (measure_role = 'flow' AND v BETWEEN 0 AND 100000) AS max_flow, min(v) FILTER (measure_role = 'flow' AND v BETWEEN 0 AND 100000) AS min_flow, count(*) AS boiler_records
                               FROM plant_fact WHERE system_type = 'boiler' AND regexp_matches(equipment_id, '^boiler_[0-9]+$') AND point_code NOT LIKE '%GAS_TOTAL%' GROUP BY ALL) USING (station_id, number, stat_hour)))""",
    "plant_cchp": """
        SELECT station_id, 'cchp' AS system_type, 'cchp_system' AS equipment_id, stat_hour, avg_supply_temp, max_supply_temp, min_supply_temp, avg_return_temp, avg_pressure, max_pressure, min_pressure, avg_flow, max_flow, min_flow,
               NULL::DOUBLE AS avg_power, NULL::DOUBLE AS max_power, NULL::DOUBLE AS min_power, input AS energy_consumption_kwh, input AS energy_input_kwh, cold AS cooling_capacity_kw, supply AS supply_kwh, cold AS cooling_supply_kwh, heat AS heating_supply_kwh, electric AS electric_supply_kwh,
               run AS runtime_hours, NULL::DOUBLE AS cumulative_runtime_hours, NULL::DOUBLE AS start_count, running_sample_count, run * 60 AS run_minutes, run * 100 AS operation_rate, coalesce(cchp_records, 0) + coalesce(generator_records, 0) AS record_count, 'mixed' AS supply_price_type,
               'cumulative_delta' AS metric_quality, stat_hour::DATE AS dt
        FROM (SELECT *, coalesce(gas * 9.7, CASE WHEN supply > 0 THEN supply / 0.8 ELSE 0.0 END) AS input, CASE WHEN supply > 0 THEN 1.0 ELSE coalesce(generator_runtime, 0.0) END AS run
              FROM (SELECT *, heat + cold + electric AS supply
                    FROM (SELECT station_id, stat_hour, coalesce(sum(advance) FILTER (point_code = 'FT2005_RL_C' AND advance <= 200000), 0.0) AS heat, coalesce(sum(advance) FILTER (point_code = 'P9_ADDH' AND advance <= 200000), 0.0) AS cold,
                                 coalesce(sum(advance) FILTER (point_code LIKE 'SLG_JZ%' AND advance <= 500000), 0.0) AS electric, sum(advance) FILTER (point_code = 'FDJ_GAS_TOTAL' AND advance <= 300000) AS gas
                          FROM plant_advances WHERE system_type = 'cchp' AND point_code IN ('FT2005_RL_C', 'P9_ADDH') OR system_type = 'generator' AND (regexp_matches(point_code, '^SLG_JZ[0-9]+_DD_YG_ZZ1$') OR point_code = 'FDJ_GAS_TOTAL') GROUP BY ALL))
              LEFT JOIN (SELECT station_id, stat_hour, coalesce(avg(v) FILTER (point_code = 'TT2005_T' AND v BETWEEN 0 AND 120), avg(v) FILTER (measure_role = 'supply_temp' AND v BETWEEN 0 AND 120)) AS avg_supply_temp,
                                coalesce(max(v) FILTER (point_code = 'TT2005_T' AND v BETWEEN 0 AND 120), max(v) FILTER (measure_role = 'supply_temp' AND v BETWEEN 0 AND 120)) AS max_supply_temp,
                                coalesce(min(v) FILTER (point_code = 'TT2005_T' AND v BETWEEN 0 AND 120), min(v) FILTER (measure_role = 'supply_temp' AND v BETWEEN 0 AND 120)) AS min_supply_temp,
                                coalesce(avg(v) FILTER (point_code = 'TT2004_T' AND v BETWEEN 0 AND 120), avg(v) FILTER (measure_role = 'return_temp' AND v BETWEEN 0 AND 120)) AS avg_return_temp,
                                avg(v) FILTER (measure_role = 'pressure' AND v BETWEEN 0 AND 10) AS avg_pressure, max(v) FILTER (measure_role = 'pressure' AND v BETWEEN 0 AND 10) AS max_pressure, min(v) FILTER (measure_role = 'pressure' AND v BETWEEN 0 AND 10) AS min_pressure,
                                avg(v) FILTER (measure_role = 'flow' AND v BETWEEN 0 AND 100000) AS avg_flow, max(v) FILTER (measure_role = 'flow' AND v BETWEEN 0 AND 100000) AS max_flow, min(v) FILTER (measure_role = 'flow' AND v BETWEEN 0 AND 100000) AS min_flow, count(*) AS cchp_records
                         FROM plant_fact WHERE system_type = 'cchp' GROUP BY ALL) USING (station_id, stat_hour)
              LEFT JOIN (SELECT station_id, stat_hour, avg(v) FILTER (v BETWEEN 0 AND 1) AS generator_runtime, count(*) FILTER (v > 0) AS running_sample_count, count(*) AS generator_records
                         FROM plant_fact WHERE system_type = 'generator' AND regexp_matches(point_code, '^[0-9]+FDJ_RUN$') GROUP BY ALL) USING (station_id, stat_hour))""",
}

_SHOWN = [c for c in HOURLY if c not in ("created_at", "updated_at")]
_WHOLE = ["running_sample_count", "record_count"]
_TEXT = ["station_id", "system_type", "equipment_id", "stat_hour", "supply_price_type", "metric_quality", "dt"]
_DOUBLES = " ".join(c for c in _SHOWN if c not in _WHOLE + _TEXT)
_KINDS = {"doubles": _DOUBLES, "times": "stat_hour", "dates": "dt", "longs": "running_sample_count record_count"}
_CURVE = """SELECT station_id, equipment_id, stat_hour, avg_supply_temp, max_supply_temp, min_supply_temp, avg_return_temp, avg_pressure, max_pressure, min_pressure, avg_flow, max_flow, min_flow, avg_power, max_power, min_power,
    energy_consumption_kwh, cooling_capacity_kw, cooling_supply_kwh, runtime_hours, cumulative_runtime_hours, start_count, running_sample_count, run_minutes, operation_rate, record_count, dt FROM plant_curve"""
_CHILLER = f"""SELECT station_id, 'chiller' AS system_type, equipment_id, stat_hour, avg_supply_temp, max_supply_temp, min_supply_temp, avg_return_temp, avg_pressure, max_pressure, min_pressure, avg_flow, max_flow, min_flow, avg_power, max_power, min_power,
    energy_consumption_kwh, energy_consumption_kwh AS energy_input_kwh, cooling_capacity_kw, cooling_supply_kwh AS supply_kwh, cooling_supply_kwh, 0.0 AS heating_supply_kwh, 0.0 AS electric_supply_kwh, runtime_hours, cumulative_runtime_hours,
    start_count, running_sample_count, run_minutes, operation_rate, record_count, 'cooling' AS supply_price_type, 'chiller_status_derived' AS metric_quality, dt FROM plant_curve"""


@query(f"""
    SELECT event_id, n, point_code, 'station_1' AS station_id, point_name, system_type, equipment_id, theme, measure_role, {_UNITS} AS unit, event_time,
           CASE WHEN value IS NOT NULL THEN value WHEN theme = 'status' OR (theme IN ('temperature', 'pressure', 'flow', 'power') AND gap_s <= 300) THEN before END AS value,
           CASE WHEN value IS NULL AND gap_s > 300 THEN 'long_missing' WHEN value IS NULL AND theme IN ('cumulative', 'runtime') THEN 'cumulative_gap' WHEN theme = 'status' AND gap_s > 3600 THEN 'status_stale' ELSE 'normal' END AS quality_flag
    FROM (SELECT event_id, n, point_code, ts AS event_time, value, lag(value) OVER w AS before, floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER w))::BIGINT AS gap_s
          FROM plant_readings WHERE point_code <> 'GHOST' WINDOW w AS (PARTITION BY point_code ORDER BY ts)) JOIN plant p USING (n, point_code)
    UNION ALL
    SELECT event_id, n, 'GHOST', NULL, NULL, NULL, NULL, NULL, NULL, NULL, event_time, value, CASE WHEN value IS NULL AND gap_s > 300 THEN 'long_missing' ELSE 'normal' END
    FROM (SELECT event_id, n, ts AS event_time, value, floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER (ORDER BY ts)))::BIGINT AS gap_s FROM plant_readings WHERE point_code = 'GHOST' AND n < {len(CHILLER_POINTS)})
    """, doubles="value", times="event_time")  # fmt: skip
def point_fact(t):
    """The standardised fact. Of the unknown point only the first of an event's two readings is used, so that times are distinct."""
    rows = _readings(t).filter((F.col("sensor_id") != "GHOST") | (F.col("n") < len(CHILLER_POINTS)))
    return silver.point_fact(rows.select("event_id", "n", "sensor_id", "timestamp", "value"), _points(t)).drop("dt")


@query(f"""
    SELECT event_id, n, r.point_code, CASE WHEN r.point_code <> 'GHOST' THEN 'station_1' END AS station_id, system_type, equipment_id, theme, {_UNITS} AS unit, ts AS event_time, value,
           CASE WHEN value IS NULL THEN 'missing' ELSE 'normal' END AS quality_flag
    FROM plant_readings r LEFT JOIN plant p USING (n, point_code) WHERE event_id % 13 <> 5""", doubles="value", times="event_time")  # fmt: skip
def stream_fact(t):
    """The fact of a micro-batch: nothing is filled, and readings whose time can't be read (every 13th) go."""
    rows = _readings(t).withColumn("timestamp", F.when(F.col("event_id") % 13 == 5, "at noon").otherwise(F.col("timestamp")))
    made = silver.stream_fact(rows.select("event_id", "n", "sensor_id", "timestamp", "value"), _points(t))
    return made.select("event_id", "n", "point_code", "station_id", "system_type", "equipment_id", "theme", "unit", "event_time", "value", "quality_flag")


@query("SELECT * FROM plant_minutes", doubles="supply_temp return_temp pressure flow power runtime_hours start_count run_flag", times="stat_minute", dates="dt")
def minute_status(t):
    return silver.minute_status(_fact(t))


@query(_CURVE, doubles=" ".join(c for c in _DOUBLES.split() if c in _CURVE.replace(",", " ").split()), times="stat_hour", dates="dt", longs="running_sample_count record_count")
def supply_curve(t):
    return hourly.supply_curve(silver.minute_status(_fact(t)))


@query("SELECT * FROM plant_heating", **_KINDS)
def heating_hours(t):
    return hourly.heating_hours(_fact(t)).drop("created_at", "updated_at")


@query("SELECT * FROM plant_cchp", **_KINDS)
def cchp_hours(t):
    return hourly.cchp_hours(_fact(t)).drop("created_at", "updated_at")


@query(f"{_CHILLER} UNION ALL BY NAME SELECT * FROM plant_heating UNION ALL BY NAME SELECT * FROM plant_cchp", **_KINDS)
def system_hours(t):
    """The unified hourly table of all three systems."""
    fact = _fact(t)
    return hourly.system_hours(hourly.supply_curve(silver.minute_status(fact)), fact).drop("created_at", "updated_at")


@query(f"{_CHILLER} UNION ALL BY NAME SELECT * FROM plant_heating UNION ALL BY NAME SELECT * FROM plant_cchp", **_KINDS)
def late_system_hours(t):
    """The unified hours of a stored lake that every 97th reading has reached late: change propagation gives the rows of a full build."""
    fact = _fact(t).withColumns({"source_topic": F.lit("events"), "partition_id": F.col("n").cast("int"), "offset_id": F.col("event_id")}).drop("event_id", "n", "event_type")
    late = F.col("offset_id") % 97 == 0
    chain = Chain(t.spark, Lake(scratch_folder(t.spark, "lake")), periods=())
    early = fact.filter(~late)
    early.write.partitionBy("dt").parquet(chain.lake.path("fact"))
    early = chain.lake.read(t.spark, "fact")
    chain.minutes(early).write.partitionBy("dt").parquet(chain.lake.path("minutes"))
    chain.hours(chain.lake.read(t.spark, "minutes"), early).write.partitionBy("dt").parquet(chain.lake.path("hours"))
    chain.add(fact.filter(late))
    return chain.lake.read(t.spark, "hours").select(*HOURLY).drop("created_at", "updated_at")
