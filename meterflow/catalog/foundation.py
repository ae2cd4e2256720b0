"""Queries of sources, classification, joins, aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterflow.catalog.base import ORACLE_SQL, query
from meterflow.functions import classify, scalars
from meterflow.operators import aggregates, chunks, joins, upsert, windows
from meterflow.plans import audit
from meterflow.sources import readers, sinks
from meterflow.streaming import microbatch


def _envelopes(t):
    """Events as message envelopes: JSON payloads, some malformed, some without a sensor id."""
    payload = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, F.concat_ws("_", "event_type", F.col("user_id").cast("string"))).alias("sensor_id"), F.lit("x").alias("label"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("value")))
    return t.events.select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("key_"), F.col("user_id").cast("string"))).alias("key"), F.when(F.col("event_id") % 50 == 7, "{broken").otherwise(payload).alias("value"), F.concat(F.lit("sensor_"), "event_type").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))


@query("""
    SELECT CASE WHEN event_id % 50 <> 7 AND event_id % 3 <> 0 THEN event_type || '_' || user_id WHEN event_id % 2 = 0 THEN 'key_' || user_id ELSE event_type END AS sensor_id,
           CASE WHEN event_id % 50 <> 7 THEN value END AS value, 'sensor_' || event_type AS source_topic, user_id % 3 AS partition_id, event_id AS offset_id,
           CASE WHEN event_id % 50 <> 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS timestamp FROM events""", doubles="value")
def decode_messages(t):
    return readers.decode(_envelopes(t)).select("sensor_id", "value", "source_topic", "partition_id", "offset_id", "timestamp")


@query("""
    SELECT event_type AS sensor_id, CASE WHEN event_id % 50 <> 7 THEN value END AS value, user_id % 3 AS partition_id, event_id AS offset_id FROM events""", doubles="value")
def decode_messages_by_topic(t):
    """The variant in which the topic names the sensor, whatever the payload says."""
    return readers.decode(_envelopes(t), sensor_from="topic").select("sensor_id", "value", "partition_id", "offset_id")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def decode_json_props(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


def _log(t):
    """Orders as a change log: one event for each customer, its orders as changed rows."""
    row = F.struct(*[c.cast("string").alias(f"UNKNOWN_COL{i}") for i, c in enumerate((F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice").cast("decimal(18,2)"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd")))])
    none = F.lit(None).cast("struct<UNKNOWN_COL0:string,UNKNOWN_COL1:string,UNKNOWN_COL2:string,UNKNOWN_COL3:string,UNKNOWN_COL4:string,UNKNOWN_COL5:string>")
    change = F.struct(F.when(F.col("o_orderkey") % 2 == 0, row).alias("values"), none.alias("before_values"), F.when(F.col("o_orderkey") % 2 == 1, row).alias("after_values"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", change.alias("c")))), lambda x: x["c"])
    return t.orders.groupBy("o_custkey").agg(rows.alias("rows")).select(F.lit("energy_prices").alias("schema"), F.when(F.col("o_custkey") % 5 == 0, "other").otherwise("prices").alias("table"), F.when(F.col("o_custkey") % 3 == 0, "WriteRowsEvent").when(F.col("o_custkey") % 3 == 1, "UpdateRowsEvent").otherwise("DeleteRowsEvent").alias("type"), F.lit("log.1").alias("log_file"), F.col("o_custkey").alias("log_pos"), F.lit(0).cast("bigint").alias("timestamp"), "rows")


@query("""
    SELECT 'log.1:' || o_custkey || ':' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS event_id, o_orderkey AS id, o_orderstatus AS station_code, o_orderpriority AS price_type,
           o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey % 3 <> 2""", doubles="price")
def flatten_change_log(t):
    return readers.flatten_changes(_log(t)).select("event_id", "id", "station_code", "price_type", "price", "updated_at")


@query("""
    SELECT station_code, price_type, effective_date, id, price, strftime(effective_date, '%Y-%m') AS price_year_month FROM (
        SELECT *, updated_at::DATE AS effective_date, row_number() OVER (PARTITION BY station_code, price_type, updated_at::DATE ORDER BY updated_at DESC, id DESC) AS rn FROM prices) WHERE rn = 1""", doubles="price", dates="effective_date")
def price_dimension(t):
    return readers.latest_prices(t.prices).select("station_code", "price_type", "effective_date", "id", "price", "price_year_month")


@query("SELECT id, price, 'incremental' AS source_type, strftime(updated_at, '%Y%m') AS ym FROM prices WHERE id % 3 <> 0", doubles="price")
def price_sync_new_rows(t):
    """Rows that an incremental sync adds to those that are there (every third id)."""
    there, landed = t.prices.filter("id % 3 = 0"), sinks.partition_price_sync(t.prices, "incremental")
    return upsert.new_rows(there, landed, ["id", "updated_at"]).select("id", "price", "source_type", "ym")


@query("""
    SELECT c AS point_code, arg_min(l, p) AS point_name, count(DISTINCT l) AS labels FROM (
        SELECT page_id AS p, unnest(regexp_extract_all(html, '<(\\w+)[^>]*>([^<]+)<', 1)) AS c, unnest(regexp_extract_all(html, '<(\\w+)[^>]*>([^<]+)<', 2)) AS l, generate_subscripts(regexp_extract_all(html, '<(\\w+)[^>]*>([^<]+)<', 1), 1) AS n FROM pages)
    GROUP BY c""".replace("arg_min(l, p)", "arg_min(l, (p, n))").replace("\\\\", "\\"))
def extract_dictionary(t):
    """Codes and first labels from text by one pattern: here tags and their text from pages."""
    return readers.extract_points(t.pages, "html", ["page_id"], r"<(\w+)[^>]*>([^<]+)<")


@query("""
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 1 THEN 'S' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def upsert_orders(t):
    """Two thirds are there; a third of them is replaced, the rest is added."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    source = rows.filter("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 1, "S").otherwise(F.col("o_orderstatus")))
    return upsert.upsert(rows.filter("o_orderkey % 3 <> 2"), source, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 3 = 2")
def insert_only_orders(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    again = rows.filter("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.lit("N"))
    return upsert.insert_only(rows.filter("o_orderkey % 3 <> 2"), again.unionByName(again), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0) UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 40 = 0")
def replace_customer_groups(t):
    rows = t.orders.select("o_orderkey", "o_custkey")
    return upsert.replace_groups(rows, rows.filter("o_orderkey % 40 = 0"), ["o_custkey"])


@query("SELECT o_orderkey AS id, o_totalprice AS price, NULL::VARCHAR AS note FROM orders", doubles="price")
def align_and_union(t):
    """Rows of another shape are cast, missing columns are NULL, repeated keys go."""
    like = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(None).cast("string").alias("note"))
    other = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"))
    return upsert.union_aligned(other, like, ["id"])


_NAME = "CASE p_partkey % 9 WHEN 0 THEN (p_partkey % 7) || '#站' || (p_partkey % 12) || '#冷机冷冻水出水温度' WHEN 1 THEN (p_partkey % 7) || '#站' || (p_partkey % 12) || '#锅炉压力' WHEN 2 THEN '三联供流量' WHEN 3 THEN (p_partkey % 12) || '#发电机电能' WHEN 4 THEN '2#站冷水总管压力' WHEN 5 THEN (p_partkey % 12) || '#燃烧机运行时间' WHEN 6 THEN '1#站5#冷机冷冻水回水温度' WHEN 7 THEN (p_partkey % 12) || '#燃烧机负荷' ELSE p_name END"


def _points(t):
    return t.part.select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("point_code"), F.expr(_NAME).alias("point_name"))


_CLASS = f"""
    SELECT p_partkey, n AS point_name, CASE WHEN regexp_matches(n, '[0-9]+#站') THEN 'station_' || regexp_extract(n, '([0-9]+)#站', 1) ELSE 'unknown' END AS station_id, s AS system_type, th AS theme,
           CASE WHEN regexp_matches(n, '[0-9]+#(冷机|锅炉|三联供|发电机|燃烧机)') THEN s || '_' || regexp_extract(n, '([0-9]+)#(冷机|锅炉|三联供|发电机|燃烧机)', 1) WHEN s = 'chiller' AND n LIKE '%冷水%压力%' THEN 'chiller_header' ELSE 'P' || p_partkey END AS equipment_id,
           CASE th WHEN 'temperature' THEN '℃' WHEN 'pressure' THEN 'MPa' WHEN 'flow' THEN 'm³/h' WHEN 'status' THEN 'bool' WHEN 'cumulative' THEN 'kWh' WHEN 'load' THEN '%' ELSE 'unknown' END AS unit,
           CASE WHEN n LIKE '%出水温度%' THEN 'supply_temp' WHEN n LIKE '%回水温度%' THEN 'return_temp' WHEN th IN ('pressure', 'flow', 'status') THEN th END AS measure_role
    FROM (SELECT p_partkey, n, CASE WHEN n LIKE '%发电机%' THEN 'generator' WHEN n LIKE '%冷机%' OR n LIKE '%冷水%压力%' THEN 'chiller' WHEN n LIKE '%锅炉%' THEN 'boiler' WHEN n LIKE '%三联供%' THEN 'cchp' WHEN n LIKE '%燃烧机%' THEN 'burner' ELSE 'other' END AS s,
                 CASE WHEN n LIKE '%温度%' THEN 'temperature' WHEN n LIKE '%压力%' THEN 'pressure' WHEN n LIKE '%流量%' THEN 'flow' WHEN n LIKE '%运行%' THEN 'status' WHEN n LIKE '%电能%' THEN 'cumulative' WHEN n LIKE '%负荷%' THEN 'load' ELSE 'other' END AS th
          FROM (SELECT p_partkey, {_NAME} AS n FROM part))"""


@query(_CLASS)
def classify_points(t):
    return classify.classify_points(_points(t)).select("p_partkey", "point_name", "station_id", "system_type", "theme", "equipment_id", "unit", "measure_role")


@query(f"SELECT system_type, theme, measure_role, unit, count(*) AS rows, count(DISTINCT equipment_id) AS distinct_equipment_id, count(p_partkey) AS non_null_rows, count(*) FILTER (p_partkey > 0) AS positive_rows FROM ({_CLASS}) GROUP BY ALL")
def point_coverage(t):
    return aggregates.coverage_counts(classify.classify_points(_points(t)), ["system_type", "theme", "measure_role", "unit"], ["equipment_id"], "p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name || ' ' || p_type) LIKE '%ring%' OR lower(p_name || ' ' || p_type) LIKE '%promo%'")
def candidate_points(t):
    return joins.text_filter(t.part, ["p_name", "p_type"], ["Ring", "PROMO"]).select("p_partkey")


@query("""SELECT DISTINCT equipment_id, CASE user_id % 3 WHEN 0 THEN 'chiller' WHEN 1 THEN 'heating' ELSE 'cchp' END AS inferred FROM readings""")
def infer_systems(t):
    system = F.get(F.array(F.lit("chiller"), F.lit("boiler"), F.lit("generator")), (F.col("user_id") % 3).cast("int"))
    named = t.readings.select("equipment_id", F.concat_ws("_", system, "equipment_id").alias("full_id")).distinct()
    return named.select("equipment_id", classify.system_of_equipment(F.col("full_id")).alias("inferred"))


@query("""
    SELECT event_id, CASE WHEN value - 50 >= 0 THEN value - 50 END AS value_clean, CASE WHEN value > 50 THEN 1 ELSE 0 END AS run_flag, CASE WHEN value BETWEEN 10 AND 90 AND event_type <> 'error' THEN value END AS guarded
    FROM readings WHERE regexp_matches(equipment_id, '^unit_[0-9]$') AND event_type IN ('view', 'error', 'signup')""", doubles="value_clean guarded", longs="run_flag")
def clean_values(t):
    rows = t.readings.filter(F.col("equipment_id").rlike("^unit_[0-9]$") & F.col("event_type").isin("view", "error", "signup"))
    return rows.select("event_id", scalars.non_negative(F.col("value") - 50).alias("value_clean"), scalars.running_flag("value").alias("_x"), F.when(F.col("value") > 50, 1).otherwise(0).alias("run_flag"), scalars.guard("value", 10, 90, F.col("event_type") != "error").alias("guarded")).drop("_x")


# Joins


@query("""SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10""")
def enrich_facts(t):
    parts = t.part.filter("p_size > 10")
    return joins.enrich(t.lineitem, parts.unionByName(parts), "l_partkey", "p_partkey", ["p_name", "p_brand"]).select("l_orderkey", "l_linenumber", "p_name", "p_brand")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unmatched_points(t):
    return joins.unmatched(t.lineitem, t.part.filter("p_size > 10"), "l_partkey", "p_partkey")


@query("SELECT station_id, equipment_id, stat_hour, supply_kwh FROM hours WHERE (station_id, stat_hour) IN (SELECT station_id, stat_hour FROM hours WHERE equipment_id = 'unit_3') OR (station_id, stat_hour) IN (SELECT station_id, stat_hour + INTERVAL 1 HOUR FROM hours WHERE equipment_id = 'unit_3')", doubles="supply_kwh", times="stat_hour")
def affected_hours(t):
    """Hours of the stations that changes of one unit touch, with the hours after."""
    touched = joins.with_next_hour(t.hours.filter("equipment_id = 'unit_3'").select("station_id", "stat_hour").distinct(), "stat_hour")
    return joins.affected(t.hours, touched, ["station_id", "stat_hour"]).select("station_id", "equipment_id", "stat_hour", "supply_kwh")


@query("""
    SELECT u.equipment_id, u.stat_hour, coalesce(u.avg_power, h.p) AS avg_power FROM hours u LEFT JOIN
        (SELECT station_id, stat_hour, max(avg_power) AS p FROM hours WHERE equipment_id = 'unit_0' GROUP BY ALL) h USING (station_id, stat_hour) WHERE u.equipment_id <> 'unit_0'""", doubles="avg_power", times="stat_hour")
def header_fill(t):
    units, header = t.hours.filter("equipment_id <> 'unit_0'"), t.hours.filter("equipment_id = 'unit_0'")
    return joins.fill_from_header(units, header, ["station_id", "stat_hour"], "avg_power").select("equipment_id", "stat_hour", "avg_power")


@query("""
    SELECT station_id, stat_hour, v AS heat, c AS cold, p AS electric FROM (SELECT station_id, date_trunc('hour', event_time) AS stat_hour, sum(value::DECIMAL(18,2))::DOUBLE AS v FROM readings WHERE event_type = 'view' GROUP BY ALL)
    FULL JOIN (SELECT station_id, date_trunc('hour', event_time) AS stat_hour, sum(value::DECIMAL(18,2))::DOUBLE AS c FROM readings WHERE event_type = 'click' GROUP BY ALL) USING (station_id, stat_hour)
    FULL JOIN (SELECT station_id, date_trunc('hour', event_time) AS stat_hour, sum(value::DECIMAL(18,2))::DOUBLE AS p FROM readings WHERE event_type = 'purchase' GROUP BY ALL) USING (station_id, stat_hour)""", doubles="heat cold electric", times="stat_hour")
def assemble_carriers(t):
    rows = t.readings.withColumn("stat_hour", F.date_trunc("hour", "event_time"))
    one = lambda kind, name: rows.filter(F.col("event_type") == kind).groupBy("station_id", "stat_hour").agg(scalars.decimal_sum("value").alias(name))
    return joins.assemble([one("view", "heat"), one("click", "cold"), one("purchase", "electric")], ["station_id", "stat_hour"])


@query("""
    SELECT a.equipment_id, a.stat_hour, b.supply_kwh AS at_1, c.supply_kwh AS at_24 FROM hours a LEFT JOIN hours b ON a.equipment_id = b.equipment_id AND b.stat_hour = a.stat_hour - INTERVAL 1 HOUR
    LEFT JOIN hours c ON a.equipment_id = c.equipment_id AND c.stat_hour = a.stat_hour - INTERVAL 24 HOUR""", doubles="at_1 at_24", times="stat_hour")
def values_at_offsets(t):
    return joins.at_offset(t.hours.select("equipment_id", "stat_hour"), t.hours, ["equipment_id"], "stat_hour", "supply_kwh", [1, 24])


@query("""
    WITH a AS (SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderpriority LIKE '1%')
    SELECT custkey, 'customers' AS side FROM a WHERE custkey NOT IN (FROM b) UNION ALL SELECT custkey, 'orders' FROM b WHERE custkey NOT IN (FROM a)""")
def key_coverage(t):
    """Customers outside a segment against customers with an urgent order: each side has some of its own."""
    customers = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("custkey"))
    orders = t.orders.filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("custkey"))
    return joins.coverage(customers, orders, ["custkey"], ("customers", "orders"))


@query("""
    SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, count(*) FILTER (abs(x - y) > 100000) AS total_mismatch
    FROM (SELECT o_orderkey AS k, o_orderkey AS a, o_totalprice AS x FROM orders) FULL JOIN (SELECT l_orderkey AS k, l_orderkey AS b, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS y FROM lineitem GROUP BY l_orderkey) USING (k)""")
def reconcile_orders(t):
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(scalars.decimal_sum("l_extendedprice").alias("lines"))
    return joins.reconcile(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total")), sums, ["k"], {"total": "lines"}, 100_000)


@query("SELECT station_id || '_' || i AS station_id, count(*) AS rows FROM readings, range(5) r(i) GROUP BY ALL")
def replicate_stations(t):
    return aggregates.frequencies(joins.replicate(t.readings, 5, "station_id"), ["station_id"])


@query("""SELECT strftime(h.stat_hour, '%Y-%m-%d') AS day, h.equipment_id, count(*) AS rows, sum(h.supply_kwh::DECIMAL(18,2))::DOUBLE AS supply FROM hours h JOIN (SELECT equipment_id, stat_hour::DATE AS d FROM hours GROUP BY ALL HAVING count(*) >= 3) r
    ON h.equipment_id = r.equipment_id AND h.stat_hour::DATE = r.d GROUP BY ALL""", doubles="supply")
def hours_of_full_days(t):
    days = t.hours.groupBy("equipment_id", F.to_date("stat_hour").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").withColumnRenamed("equipment_id", "e")
    joined = t.hours.join(days, (F.col("equipment_id") == F.col("e")) & (F.to_date("stat_hour") == F.col("d")))
    return joined.groupBy(F.col("d").cast("string").alias("day"), "equipment_id").agg(F.count(F.lit(1)).alias("rows"), scalars.decimal_sum("supply_kwh").alias("supply"))


# Aggregations


@query("""
    SELECT station_id, equipment_id, date_trunc('minute', event_time) AS stat_minute, max(value) FILTER (measure_role = 'supply_temp') AS supply_temp, max(value) FILTER (measure_role = 'return_temp') AS return_temp, max(value) FILTER (measure_role = 'pressure') AS pressure,
           max(value) FILTER (measure_role = 'flow') AS flow, count(*) AS record_count FROM readings GROUP BY ALL""", doubles="supply_temp return_temp pressure flow", times="stat_minute")
def minute_pivot(t):
    role = F.col("measure_role")
    rows = t.readings.withColumn("stat_minute", F.date_trunc("minute", "event_time"))
    return aggregates.conditional_pivot(rows, ["station_id", "equipment_id", "stat_minute"], "value", {r: role == r for r in ("supply_temp", "return_temp", "pressure", "flow")})


@query("SELECT equipment_id, date_trunc('hour', event_time) AS stat_hour, avg(value) AS avg_value, max(value) AS max_value, min(value) AS min_value, count(*) AS record_count FROM readings GROUP BY ALL", doubles="avg_value max_value min_value", times="stat_hour")
def hourly_rollup(t):
    return aggregates.rollup(t.readings.withColumn("stat_hour", F.date_trunc("hour", "event_time")), ["equipment_id", "stat_hour"], {"value": ("avg", "max", "min")})


@query("SELECT station_id, sum(value::DECIMAL(18,2)) FILTER (event_type = 'view') AS view, sum(value::DECIMAL(18,2)) FILTER (event_type = 'click') AS click FROM readings GROUP BY ALL", doubles="view click")
def pivot_by_type(t):
    return aggregates.pivot_listed(t.readings.withColumn("value", F.col("value").cast("decimal(18,2)")), ["station_id"], "event_type", ["view", "click"], "value")


@query("SELECT * FROM price_row", doubles="electricity_price cooling_price heating_price gas_price")
def mean_prices(t):
    return t.price_row


@query("""SELECT equipment_id, sum(cooling_supply_kwh) / sum(supply_kwh) AS cooling_supply_kwh_share, coalesce(sum(energy_consumption_kwh), 0) / sum(supply_kwh) AS energy_consumption_kwh_share FROM hours GROUP BY ALL""", doubles="cooling_supply_kwh_share energy_consumption_kwh_share")
def carrier_mix(t):
    return aggregates.mix_shares(t.hours, ["equipment_id"], "supply_kwh", ["cooling_supply_kwh", "energy_consumption_kwh"])


@query("""
    SELECT equipment_id, hour_of_day, day_of_week, avg(supply_kwh) AS mean_value, count(*) AS samples, 2 - grouping(hour_of_day) - grouping(day_of_week) AS depth
    FROM (SELECT *, hour(stat_hour)::BIGINT AS hour_of_day, dayofweek(stat_hour)::BIGINT + 1 AS day_of_week FROM hours) GROUP BY GROUPING SETS ((equipment_id, hour_of_day, day_of_week), (equipment_id, hour_of_day), (equipment_id))""", doubles="mean_value", longs="depth hour_of_day day_of_week")
def seasonal_profiles(t):
    rows = t.hours.withColumns({"hour_of_day": F.hour("stat_hour"), "day_of_week": F.dayofweek("stat_hour")})
    return aggregates.seasonal_profiles(rows, ["equipment_id"], ["hour_of_day", "day_of_week"], "supply_kwh")


def _profile_sql(columns, table):
    one = "SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS non_null, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most, avg({c}) AS mean, stddev_samp({c}) AS deviation, count(*) - count({c}) AS nulls, count({c}) * 100.0 / count(*) AS non_null_pct FROM {t}"
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


@query(_profile_sql(["supply_kwh", "energy_consumption_kwh", "operation_rate", "avg_supply_temp"], "hours"), doubles="least most mean deviation non_null_pct")
def profile_columns(t):
    return aggregates.column_profile(t.hours, ["supply_kwh", "energy_consumption_kwh", "operation_rate", "avg_supply_temp"])


@query("SELECT count(*) AS rows, count(DISTINCT station_id) AS distinct_station_id, count(DISTINCT equipment_id) AS distinct_equipment_id, min(event_time) AS first_event_time, max(event_time) AS last_event_time FROM readings", times="first_event_time last_event_time")
def table_overview(t):
    return aggregates.overview(t.readings, ["station_id", "equipment_id"], ["event_time"])


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return aggregates.duplicate_keys(t.orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["o_custkey", "month"])


@query("SELECT event_type, measure_role, count(*) AS rows FROM readings GROUP BY ALL")
def value_frequencies(t):
    return aggregates.frequencies(t.readings, ["event_type", "measure_role"])


@query("SELECT equipment_id, count(*) AS rows, sum(supply_kwh) AS total_supply_kwh, sum(energy_consumption_kwh) AS total_energy_consumption_kwh, avg(operation_rate) AS mean_operation_rate FROM hours GROUP BY ALL", doubles="total_supply_kwh total_energy_consumption_kwh mean_operation_rate")
def equipment_summary(t):
    return aggregates.summary(t.hours, ["equipment_id"], ["supply_kwh", "energy_consumption_kwh"], ["operation_rate"])


@query("SELECT equipment_id, count(avg_supply_temp) AS supply_hours, count(*) FILTER (supply_kwh > 0) AS positive_hours, avg(avg_return_temp - avg_supply_temp) AS mean_difference FROM hours GROUP BY ALL", doubles="mean_difference")
def field_summary(t):
    return t.hours.groupBy("equipment_id").agg(F.count("avg_supply_temp").alias("supply_hours"), F.count_if(F.col("supply_kwh") > 0).alias("positive_hours"), F.avg(F.col("avg_return_temp") - F.col("avg_supply_temp")).alias("mean_difference"))


# Windows

_GAPS = """
    SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN theme = 'status' OR (theme IN ('temperature', 'pressure', 'flow', 'power') AND gap_s <= 90000) THEN before END AS filled FROM (
        SELECT event_id, theme, value, floor(epoch(event_time))::BIGINT - floor(epoch(lag(event_time) OVER w))::BIGINT AS gap_s, lag(value) OVER w AS before FROM readings WINDOW w AS (PARTITION BY point_code ORDER BY event_time, event_id))"""


@query(f"""SELECT event_id, gap_s, filled, CASE WHEN value IS NULL AND gap_s > 90000 THEN 'long_missing' WHEN theme IN ('cumulative', 'runtime') AND value IS NULL THEN 'cumulative_gap'
    WHEN theme = 'status' AND gap_s > 180000 THEN 'status_stale' ELSE 'normal' END AS quality_flag FROM ({_GAPS})""", doubles="filled")
def gap_fill_and_flags(t):
    rows = windows.fill_gaps(t.readings, ["point_code"], "event_time", "value", "theme", ["event_id"], longest=90_000)
    return rows.select("event_id", "gap_s", "filled", windows.quality_flag("value", "theme", "gap_s", longest=90_000, stale=180_000).alias("quality_flag"))


@query("""SELECT event_id, CASE WHEN value IS NOT NULL THEN value WHEN theme = 'status' OR (theme <> 'cumulative' AND floor(epoch(event_time)) - floor(epoch(lag(event_time) OVER w)) <= 90000) THEN last_value(value IGNORE NULLS) OVER (PARTITION BY point_code ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS filled
    FROM readings WINDOW w AS (PARTITION BY point_code ORDER BY event_time, event_id)""", doubles="filled")
def gap_fill_carried(t):
    return windows.fill_gaps(t.readings, ["point_code"], "event_time", "value", "theme", ["event_id"], longest=90_000, mode="carry").select("event_id", "filled")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1", times="o_orderdate")
def latest_version(t):
    return windows.latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def latest_n_per_key(t):
    return windows.latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rn")


def _meter(t):
    """A counter for each point, set to 0 by every 50th event."""
    w = windows.series(["point_code"], ["event_time", "event_id"]).rowsBetween(Window.unboundedPreceding, 0)
    rows = t.readings.withColumn("v", F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double"))
    return rows.withColumns({"reading_value": F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("v")), "stat_hour": F.date_trunc("hour", "event_time")})


_METER = """(SELECT point_code, date_trunc('hour', event_time) AS stat_hour, CASE WHEN event_id % 50 = 0 THEN 0 ELSE v END AS reading_value FROM (SELECT *, (sum(value::DECIMAL(18,2)) OVER (PARTITION BY point_code ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS v FROM readings))"""
_ENDS = f"SELECT point_code, stat_hour, reading, reading - lag(reading) OVER (PARTITION BY point_code ORDER BY stat_hour) AS d FROM (SELECT point_code, stat_hour, max(reading_value) AS reading FROM {_METER} GROUP BY ALL)"


@query(f"SELECT point_code, stat_hour, reading, CASE WHEN d BETWEEN 0 AND 100 THEN d END AS delta FROM ({_ENDS})", doubles="reading delta", times="stat_hour")
def counter_delta(t):
    return windows.counter_delta(_meter(t), ["point_code"], "stat_hour", "reading_value", 100)


@query(f"SELECT point_code, count(d) AS advances, count(*) FILTER (d < 0) AS negative, coalesce(sum(d) FILTER (d BETWEEN 0 AND 100), 0) AS sum_to_100, coalesce(sum(d) FILTER (d BETWEEN 0 AND 200), 0) AS sum_to_200 FROM ({_ENDS}) GROUP BY ALL", doubles="sum_to_100 sum_to_200")
def counter_audit(t):
    return audit.counter_audit(_meter(t), ["point_code"], "stat_hour", "reading_value", [100, 200])


@query(f"SELECT point_code, stat_hour, reading, d AS advance FROM ({_ENDS}) WHERE d > 0 ORDER BY d DESC, point_code, stat_hour LIMIT 10", doubles="reading advance", times="stat_hour")
def largest_counter_jumps(t):
    return audit.largest_jumps(_meter(t), ["point_code"], "stat_hour", "reading_value")


@query("""SELECT l_orderkey, l_linenumber, group_weight, CASE WHEN group_weight > 0 THEN w / group_weight ELSE 1.0 / n END AS share, 1000.0 * CASE WHEN group_weight > 0 THEN w / group_weight ELSE 1.0 / n END AS allocated FROM (
    SELECT *, sum(w) OVER (PARTITION BY l_orderkey) AS group_weight, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT *, CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE l_quantity END AS w FROM lineitem))""", doubles="group_weight share allocated")
def proportional_allocation(t):
    rows = t.lineitem.withColumns({"w": F.when(F.col("l_orderkey") % 10 == 0, 0.0).otherwise(F.col("l_quantity")), "total": F.lit(1000.0)})
    return windows.allocate(rows, ["l_orderkey"], "w", "total").select("l_orderkey", "l_linenumber", "group_weight", "share", "allocated")


@query("""SELECT equipment_id, strftime(stat_hour, '%Y-%m-%d') AS day, sum((v > m * 1.2)::INT) AS peak_hours, sum((v > 0 AND v < m * 0.8)::INT) AS valley_hours FROM (SELECT *, coalesce(supply_kwh, 0) AS v, avg(coalesce(supply_kwh, 0)) OVER (PARTITION BY equipment_id, stat_hour::DATE) AS m FROM hours) GROUP BY ALL""", longs="peak_hours valley_hours")
def peak_valley_flags(t):
    rows = t.hours.withColumns({"day": F.to_date("stat_hour").cast("string"), "v": F.coalesce("supply_kwh", F.lit(0.0))})
    return windows.period_flags(rows, ["equipment_id", "day"], "v").groupBy("equipment_id", "day").agg(F.sum("is_peak").alias("peak_hours"), F.sum("is_valley").alias("valley_hours"))


@query("""SELECT equipment_id, stat_hour, lag(supply_kwh, 1) OVER w AS lag_1, lag(supply_kwh, 24) OVER w AS lag_24, lag(supply_kwh, 168) OVER w AS lag_168, avg(supply_kwh) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS avg_24, max(supply_kwh) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS max_24,
    avg(supply_kwh) OVER (w ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS avg_168, max(supply_kwh) OVER (w ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS max_168 FROM hours WINDOW w AS (PARTITION BY equipment_id ORDER BY stat_hour)""", doubles="lag_1 lag_24 lag_168 avg_24 max_24 avg_168 max_168", times="stat_hour")
def lags_and_trailing(t):
    rows = windows.lags(t.hours.select("equipment_id", "stat_hour", "supply_kwh"), ["equipment_id"], ["stat_hour"], "supply_kwh")
    return windows.trailing(rows, ["equipment_id"], ["stat_hour"], "supply_kwh").drop("supply_kwh")


@query("""SELECT equipment_id, stat_hour, avg(supply_kwh) OVER v AS avg_24, max(supply_kwh) OVER v AS max_24, min(supply_kwh) OVER v AS min_24, stddev_samp(supply_kwh) OVER v AS std_24, supply_kwh - lag(supply_kwh) OVER w AS diff_1, CASE WHEN lag(supply_kwh) OVER w <> 0 THEN (supply_kwh - lag(supply_kwh) OVER w) / lag(supply_kwh) OVER w END AS pct_change_1
    FROM hours WINDOW w AS (PARTITION BY equipment_id ORDER BY stat_hour), v AS (PARTITION BY equipment_id ORDER BY stat_hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""", doubles="avg_24 max_24 min_24 std_24 diff_1 pct_change_1", times="stat_hour")
def rolling_and_differences(t):
    rows = windows.trailing(t.hours.select("equipment_id", "stat_hour", "supply_kwh"), ["equipment_id"], ["stat_hour"], "supply_kwh", (24,), ("avg", "max", "min", "std"), current=True)
    return windows.differences(rows, ["equipment_id"], ["stat_hour"], "supply_kwh", (1,)).drop("supply_kwh")


@query("""SELECT equipment_id, stat_hour, rn <= floor(n * 0.8) AS is_train FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY stat_hour) AS rn, count(*) OVER (PARTITION BY equipment_id) AS n FROM hours) WHERE floor(n * 0.8) >= 100 AND n - floor(n * 0.8) >= 24""", times="stat_hour")
def chronological_split(t):
    return windows.chronological_split(t.hours.select("equipment_id", "stat_hour"), ["equipment_id"], ["stat_hour"], 0.8, 100, 24)


@query("""SELECT equipment_id, stat_hour, coalesce(last_value(avg_power IGNORE NULLS) OVER (PARTITION BY equipment_id ORDER BY stat_hour), first_value(avg_power IGNORE NULLS) OVER (PARTITION BY equipment_id ORDER BY stat_hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS avg_power FROM hours""", doubles="avg_power", times="stat_hour")
def clean_series(t):
    return windows.clean_series(t.hours.select("equipment_id", "stat_hour", "avg_power"), ["equipment_id"], ["stat_hour"], ["avg_power"])


@query("""SELECT g.equipment_id, g.stat_hour, h.supply_kwh FROM (SELECT equipment_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS stat_hour FROM (SELECT equipment_id, min(stat_hour) AS a, max(stat_hour) AS b FROM hours GROUP BY equipment_id)) g LEFT JOIN hours h ON g.equipment_id = h.equipment_id AND g.stat_hour = h.stat_hour""", doubles="supply_kwh", times="stat_hour")
def hour_grid(t):
    return windows.hour_grid(t.hours.select("equipment_id", "stat_hour", "supply_kwh"), ["equipment_id"], "stat_hour")


# Sketches


@query("SELECT count(*) AS rows, true AS points_within, true AS units_within FROM readings")
def distinct_by_sketches(t):
    """Distinct points and units from sketches by day, united, against the exact counts: within three standard errors of each."""
    rows = t.readings.withColumn("dt", F.to_date("event_time"))
    columns = ["point_code", "equipment_id"]
    estimate = aggregates.distinct_estimates(aggregates.distinct_sketches(rows, ["dt"], columns), columns)
    exact = rows.agg(*[F.countDistinct(c).alias(f"exact_{c}") for c in columns])
    within = lambda c: (F.abs(F.col(f"distinct_{c}") - F.col(f"exact_{c}")) <= 3 * aggregates.SKETCH_ERROR * F.col(f"exact_{c}")).alias("points_within" if c == "point_code" else "units_within")
    return estimate.join(F.broadcast(exact)).select("rows", *[within(c) for c in columns])  # a row each


# The same windows cut into chunks; their SQL is that of the plain ones


def _same(name: str):
    """Register a query whose rows must be those of another one's SQL."""

    def add(f):
        query()(f)
        ORACLE_SQL[f.__name__] = ORACLE_SQL[name]
        return f

    return add


@_same("lags_and_trailing")
def lags_and_trailing_in_chunks(t):
    def windowed(rows, keys):
        return windows.trailing(windows.lags(rows, keys, ["stat_hour"], "supply_kwh"), keys, ["stat_hour"], "supply_kwh")

    return chunks.in_chunks(t.hours.select("equipment_id", "stat_hour", "supply_kwh"), ["equipment_id"], ["stat_hour"], 168, windowed, "week").drop("supply_kwh")


@_same("rolling_and_differences")
def rolling_and_differences_in_chunks(t):
    """Chunks of a day, of which a trailing window may need two."""
    def windowed(rows, keys):
        rows = windows.trailing(rows, keys, ["stat_hour"], "supply_kwh", (24,), ("avg", "max", "min", "std"), current=True)
        return windows.differences(rows, keys, ["stat_hour"], "supply_kwh", (1,))

    return chunks.in_chunks(t.hours.select("equipment_id", "stat_hour", "supply_kwh"), ["equipment_id"], ["stat_hour"], 24, windowed, "day").drop("supply_kwh")


@_same("clean_series")
def clean_series_in_chunks(t):
    return chunks.clean_series(t.hours.select("equipment_id", "stat_hour", "avg_power"), ["equipment_id"], ["stat_hour"], ["avg_power"], "day")


@_same("counter_delta")
def counter_delta_in_chunks(t):
    return chunks.counter_delta(_meter(t), ["point_code"], "stat_hour", "reading_value", 100, unit="day")


# Streaming logic on batches


@query("SELECT count(*) AS processed_rows, min(event_time) AS first_event_time, max(event_time) AS last_event_time FROM readings WHERE event_id > 5000", times="first_event_time last_event_time")
def incremental_batch(t):
    rows = microbatch.incremental_since(t.readings.withColumn("mark", F.col("event_id")), "mark", 5000)
    return microbatch.batch_statistics(rows, "mark", "event_time").select("processed_rows", "first_event_time", "last_event_time")


@query("""SELECT station_id, equipment_id, stat_hour, avg_value FROM (SELECT station_id, equipment_id, date_trunc('hour', event_time) AS stat_hour, avg(value) AS avg_value FROM readings GROUP BY ALL) WHERE (station_id, stat_hour) IN
    (SELECT station_id, date_trunc('hour', event_time) FROM readings WHERE event_id % 97 = 0 UNION ALL SELECT station_id, date_trunc('hour', event_time) + INTERVAL 1 HOUR FROM readings WHERE event_id % 97 = 0)""", doubles="avg_value", times="stat_hour")
def recompute_affected(t):
    """Hours that a batch of late readings touches, recomputed from all readings."""
    def build(facts):
        return facts.groupBy("station_id", "equipment_id", F.date_trunc("hour", "event_time").alias("stat_hour")).agg(F.avg("value").alias("avg_value"))

    rows = t.readings.withColumn("event_time", F.col("event_time").cast("timestamp"))
    return microbatch.recompute(rows, rows.filter("event_id % 97 = 0"), ["station_id"], build)


@query("SELECT event_id, point_code, value FROM readings WHERE event_id BETWEEN (SELECT max(event_id) * 2 // 5 FROM readings) AND (SELECT max(event_id) * 3 // 5 FROM readings)", doubles="value")
def replay_interval(t):
    """The middle fifth of the table."""
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    return microbatch.replay(t.readings, "event_id", last * 2 // 5, last * 3 // 5).select("event_id", "point_code", "value")
