"""Registration of queries, and the sensor tables that they derive from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions.scalars import decimal_sum

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6
#: Added before rounding, so that an exact half with a last-bit difference rounds alike in both engines.
NUDGE = 1e-9
ROLES = {"view": "supply_temp", "click": "return_temp", "purchase": "flow", "error": "pressure", "signup": "status"}
THEMES = {"view": "temperature", "click": "temperature", "purchase": "flow", "error": "cumulative", "signup": "status"}
SYSTEMS = ["chiller", "heating", "cchp"]
PRICE_TYPES = {"1": "electricity", "2": "cooling", "3": "heating", "4": "gas"}


def _choice(column, table: dict, otherwise=None):
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def _case(column: str, table: dict, otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


class Tables:
    """The driver's tables of one folder, and what they stand for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        """Events as sensor readings; every tenth value is missing."""
        kind, user = F.col("event_type"), F.col("user_id")
        return self.events.select(
            "event_id", "user_id", "event_type", F.concat(F.lit("station_"), (user % 4).cast("string")).alias("station_id"), F.concat(F.lit("unit_"), (user % 12).cast("string")).alias("equipment_id"),
            F.concat_ws("_", kind, user.cast("string")).alias("point_code"), _choice(kind, ROLES).alias("measure_role"), _choice(kind, THEMES).alias("theme"), F.col("ts").alias("event_time"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"),
        )

    @cached_property
    def hours(self) -> DataFrame:
        """The readings of each unit and hour as an hourly table."""
        of = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("value"))
        mean = lambda kind: decimal_sum(of(kind)) / F.count(of(kind))
        system = F.array(*map(F.lit, SYSTEMS))
        rows = self.readings.withColumns({"stat_hour": F.date_trunc("hour", "event_time"), "system_type": F.get(system, (F.col("user_id") % 3).cast("int"))})
        out = rows.groupBy("station_id", "system_type", "equipment_id", "stat_hour").agg(
            mean_or_null(mean("view"), of("view")).alias("avg_supply_temp"), mean_or_null(mean("click"), of("click")).alias("avg_return_temp"), mean_or_null(mean("purchase"), of("purchase")).alias("avg_flow"), mean_or_null(mean("error"), of("error")).alias("avg_power"), mean_or_null(mean("signup"), of("signup")).alias("avg_pressure"),
            decimal_sum(of("error")).alias("energy_consumption_kwh"), decimal_sum(of("view", "click", "purchase")).alias("supply_kwh"), decimal_sum(of("view")).alias("cooling_supply_kwh"), decimal_sum(of("click")).alias("heating_supply_kwh"),
            decimal_sum(of("purchase")).alias("electric_supply_kwh"), F.count_if(of("signup") > 50).cast("double").alias("runs"), F.count(of("signup")).cast("double").alias("samples"), F.max(F.col("user_id") % 100).cast("double").alias("start_count"), F.count(F.lit(1)).alias("record_count"),
        )
        return out.withColumn("runtime_hours", F.when(F.col("samples") > 0, F.col("runs") / F.col("samples"))).withColumns({"operation_rate": F.col("runtime_hours") * 100, "run_minutes": F.col("runtime_hours") * 60}).drop("runs", "samples")

    @cached_property
    def prices(self) -> DataFrame:
        kind = _choice(F.substring("o_orderpriority", 1, 1), PRICE_TYPES, "other")
        return self.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("station_"), (F.col("o_custkey") % 4).cast("string")).alias("station_code"), kind.alias("price_type"), (F.col("o_totalprice") / 1000000).alias("price"), F.col("o_orderdate").alias("updated_at"))

    @cached_property
    def price_row(self) -> DataFrame:
        from meterflow.functions.metrics import DEFAULT_PRICES
        from meterflow.operators.aggregates import price_row

        return price_row(self.prices, "price_type", "price", DEFAULT_PRICES)


def mean_or_null(mean, value):
    """A mean that is NULL without values (an integer division by zero is an error)."""
    return F.when(F.count(value) > 0, mean)


_DSUM = "sum(CASE WHEN event_type IN ({}) THEN value END::DECIMAL(18,2))::DOUBLE"


def _dsum(*kinds: str) -> str:
    return _DSUM.format(", ".join(f"'{k}'" for k in kinds))


def _dmean(kind: str) -> str:
    return f"{_dsum(kind)} / nullif(count(CASE WHEN event_type = '{kind}' THEN value END), 0)"


CTES = {
    "readings": f"""SELECT event_id, user_id, event_type, 'station_' || (user_id % 4) AS station_id, 'unit_' || (user_id % 12) AS equipment_id, event_type || '_' || user_id AS point_code,
        {_case("event_type", ROLES)} AS measure_role, {_case("event_type", THEMES)} AS theme, ts AS event_time, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events""",
    "hours": f"""SELECT *, runtime_hours * 100 AS operation_rate, runtime_hours * 60 AS run_minutes FROM (
        SELECT station_id, CASE user_id % 3 WHEN 0 THEN 'chiller' WHEN 1 THEN 'heating' ELSE 'cchp' END AS system_type, equipment_id, date_trunc('hour', event_time) AS stat_hour,
        {_dmean("view")} AS avg_supply_temp, {_dmean("click")} AS avg_return_temp, {_dmean("purchase")} AS avg_flow, {_dmean("error")} AS avg_power, {_dmean("signup")} AS avg_pressure, {_dsum("error")} AS energy_consumption_kwh,
        {_dsum("view", "click", "purchase")} AS supply_kwh, {_dsum("view")} AS cooling_supply_kwh, {_dsum("click")} AS heating_supply_kwh, {_dsum("purchase")} AS electric_supply_kwh,
        max(user_id % 100)::DOUBLE AS start_count, count(*) AS record_count,
        count(*) FILTER (event_type = 'signup' AND value > 50)::DOUBLE / nullif(count(*) FILTER (event_type = 'signup' AND value IS NOT NULL), 0) AS runtime_hours
        FROM readings GROUP BY ALL)""",
    "prices": f"""SELECT o_orderkey AS id, 'station_' || (o_custkey % 4) AS station_code, {_case("left(o_orderpriority, 1)", PRICE_TYPES, "'other'")} AS price_type,
        o_totalprice / 1000000 AS price, o_orderdate AS updated_at FROM orders""",
    "price_row": """SELECT coalesce(avg(price) FILTER (price_type = 'electricity'), 0.8) AS electricity_price, coalesce(avg(price) FILTER (price_type = 'cooling'), 0.3) AS cooling_price,
        coalesce(avg(price) FILTER (price_type = 'heating'), 0.35) AS heating_price, coalesce(avg(price) FILTER (price_type = 'gas'), 2.8 / 9.7) AS gas_price FROM prices""",
}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions rounded, times and dates as text: what both engines show alike."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double") + NUDGE, DIGITS)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None, doubles: str = "", times: str = "", dates: str = "", longs: str = ""):
    """Register a function of Tables under its name, with SQL over the same tables; the lists name columns by kind."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: tidy(f(Tables(spark, folder)))
        if sql:
            shown = [f"round({c}::DOUBLE + {NUDGE}, {DIGITS}) AS {c}" for c in doubles.split()] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times.split()]
            shown += [f"strftime({c}::DATE, '%Y-%m-%d') AS {c}" for c in dates.split()] + [f"({c})::BIGINT AS {c}" for c in longs.split()]
            body, needed = sql.strip(), []
            while new := [n for n in CTES if n not in needed and any(_uses(x, n) for x in [body, *[CTES[m] for m in needed]])]:
                needed += new
            ctes = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
            ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + "SELECT *" + (f" REPLACE ({', '.join(shown)})" if shown else "") + f" FROM ({body})"
        return f

    return add


def _uses(sql: str, name: str) -> bool:
    import re

    return bool(re.search(rf"(\bFROM|\bJOIN|,)\s+{name}\b", sql))
