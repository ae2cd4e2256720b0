"""Audits: formulas, coverage, reconciliation, governance, timeliness and meter jumps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.operators import aggregates, windows


def formula_checks(hours: DataFrame, eps: float = 1e-4) -> DataFrame:
    """One row: hours whose figures contradict each other."""
    off = lambda a, b: F.count_if(F.abs(a - b) > eps)
    c = F.col
    return hours.agg(
        F.count(F.lit(1)).alias("rows"), off(c("energy_consumption_kwh"), c("avg_power") * c("runtime_hours")).alias("energy_mismatch"), off(c("operation_rate"), c("run_minutes") / 60 * 100).alias("rate_mismatch"),
        off(c("cooling_supply_kwh"), c("cooling_capacity_kw") * c("runtime_hours")).alias("cooling_mismatch"), F.count_if(~c("runtime_hours").between(0, 1)).alias("runtime_out_of_range"), F.count_if(~c("operation_rate").between(0, 100)).alias("rate_out_of_range"),
    )


def governance_gate(fact: DataFrame, points: DataFrame, fact_key: str, dim_key: str, role: str, prefix: str) -> DataFrame:
    """One row of counts and whether all pass: unique codes, prefix, no row lost or doubled by the join, roles known."""
    codes = points.agg(F.count(F.lit(1)).alias("points"), F.countDistinct(dim_key).alias("codes"), F.count_if(~F.col(dim_key).startswith(prefix)).alias("bad_prefix"), F.count_if(F.col(role).isNull()).alias("no_role"))
    joined = fact.join(points.select(F.col(dim_key).alias(fact_key)), fact_key, "left").agg(F.count(F.lit(1)).alias("joined_rows"))
    rows = fact.agg(F.count(F.lit(1)).alias("rows"))
    one = aggregates.with_prices(aggregates.with_prices(codes, joined), rows)
    passes = (F.col("points") == F.col("codes")) & (F.col("bad_prefix") == 0) & (F.col("no_role") == 0) & (F.col("rows") == F.col("joined_rows"))
    return one.withColumn("passes", passes)


def timeliness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each table its rows and the first and last of its time column."""
    each = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.min(F.col(ts).cast("timestamp")).alias("first_time"), F.max(F.col(ts).cast("timestamp")).alias("last_time")) for name, (df, ts) in tables.items()]
    return reduce(DataFrame.unionByName, each)


def last_hours(df: DataFrame, ts: str, n: int) -> DataFrame:
    """Rows of the last n hours before the table's latest time. That one value is read first, so that the filter reaches the scan."""
    latest = df.agg(F.max(ts).alias("latest")).first()["latest"]
    return df.filter("false") if latest is None else df.filter(F.col(ts) > F.lit(latest) - F.make_dt_interval(F.lit(0), F.lit(n)))


def counter_audit(df: DataFrame, keys: Sequence[str], bucket: str, value: str, caps: Sequence[float]) -> DataFrame:
    """By meter: negative advances, and sums of the advances under each cap."""
    ends = df.groupBy(*keys, bucket).agg(F.max(value).alias("reading"))
    d = ends.withColumn("advance", F.col("reading") - F.lag("reading").over(windows.series(keys, [bucket])))
    return d.groupBy(*keys).agg(F.count("advance").alias("advances"), F.count_if(F.col("advance") < 0).alias("negative"), *[F.coalesce(F.sum(F.when(F.col("advance").between(0, c), F.col("advance"))), F.lit(0.0)).alias(f"sum_to_{int(c)}") for c in caps])


def largest_jumps(df: DataFrame, keys: Sequence[str], bucket: str, value: str, n: int = 10) -> DataFrame:
    ends = df.groupBy(*keys, bucket).agg(F.max(value).alias("reading"))
    d = ends.withColumn("advance", F.col("reading") - F.lag("reading").over(windows.series(keys, [bucket])))
    return d.filter("advance > 0").orderBy(F.desc("advance"), *keys, bucket).limit(n)


def forecast_check(forecast: DataFrame, keys: Sequence[str], expected: int = 24) -> DataFrame:
    """By entity: rows, range, interval width, negative and NULL predictions, and whether all hours are there."""
    p = F.col("predicted_supply_kwh")
    width = F.col("confidence_upper") - F.col("confidence_lower")
    return forecast.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(p).alias("least"), F.max(p).alias("most"), F.avg(p).alias("mean"), F.avg(width).alias("mean_width"), F.count_if(p < 0).alias("negative"), F.count_if(p.isNull()).alias("missing"), (F.count(F.lit(1)) == expected).alias("complete"))


def revenue_reconciliation(forecast: DataFrame, revenue: DataFrame, keys: Sequence[str], carriers: dict[str, str], eps: float = 1e-4) -> DataFrame:
    """One row: hours that only one of forecast and revenue has, amounts that differ between them, and sums that contradict each other.

    carriers: each one's price column. revenue: predicted amounts by carrier, their prices, predicted_energy_kwh, energy_price, predicted_energy_cost, predicted_supply_revenue
    and predicted_profit.
    """
    c = F.col
    amount = lambda x: f"predicted_{x}_kwh"
    left = forecast.select(*keys, *[c(amount(x)).alias(f"forecast_{x}") for x in carriers], F.lit(True).alias("_forecast"))
    sold = sum((c(amount(x)) * c(price) for x, price in carriers.items()), F.lit(0.0))
    off = lambda a, b: F.count_if(F.abs(a - b) > eps)
    cost, income, profit = c("predicted_energy_cost"), c("predicted_supply_revenue"), c("predicted_profit")
    return left.join(revenue.withColumn("_revenue", F.lit(True)), list(keys), "full").agg(
        F.count_if(c("_forecast").isNull()).alias("missing_forecast"), F.count_if(c("_revenue").isNull()).alias("missing_revenue"), *[off(c(f"forecast_{x}"), c(amount(x))).alias(f"{x}_mismatch") for x in carriers],
        off(cost, c("predicted_energy_kwh") * c("energy_price")).alias("cost_mismatch"), off(income, sold).alias("revenue_mismatch"), off(profit, income - cost).alias("profit_mismatch"),
        F.count_if(cost < 0).alias("negative_cost"), F.count_if(profit.isNull()).alias("missing_profit"),
    )


def required_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each field that must not be NULL: rows, NULLs and whether it passes. One pass over df."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f).isNull()).alias(f"_{i}") for i, f in enumerate(fields)])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("nulls")) for i, f in enumerate(fields)])
    return one.select("rows", F.explode(each).alias("x")).select("x.field", "rows", "x.nulls", (F.col("x.nulls") == 0).alias("passes"))


def zero_forecast(hours: DataFrame, forecast: DataFrame, revenue: DataFrame, key: str = "equipment_id", ts: str = "stat_hour", recent: int = 96) -> DataFrame:
    """By equipment, why a forecast may be zero: past and recent supply, hours with any, mean operation rate, and what is predicted."""
    supply = F.coalesce("supply_kwh", F.lit(0.0))
    figures = lambda suffix: [F.count(F.lit(1)).alias(f"hours{suffix}"), F.sum(supply).alias(f"supply{suffix}"), F.count_if(F.col("supply_kwh") > 0).alias(f"positive{suffix}"), F.avg("operation_rate").alias(f"operation_rate{suffix}")]
    past = hours.groupBy(key).agg(*figures(""), F.max(ts).alias("last_hour"))
    late = windows.latest_per_key(hours, [key], [ts], recent).groupBy(key).agg(*figures("_recent"))
    ahead = forecast.groupBy(key).agg(F.count(F.lit(1)).alias("forecast_hours"), F.sum("predicted_supply_kwh").alias("predicted_supply"), F.count_if(F.col("predicted_supply_kwh") > 0).alias("positive_forecast"))
    money = revenue.groupBy(key).agg(F.sum("predicted_supply_revenue").alias("predicted_revenue"), F.sum("predicted_profit").alias("predicted_profit"))
    return past.join(late, key, "left").join(ahead, key, "left").join(money, key, "left")


def lake_statistics(tables: dict[str, DataFrame], fields: Sequence[str], distinct: Sequence[str] = (), totals: Sequence[str] = (), total=F.sum) -> DataFrame:
    """(table_name, statistic, figure as text) for every table: rows, least and most of the fields it has, distinct counts and totals."""

    def of(name: str, df: DataFrame) -> DataFrame:
        text = lambda x, f: F.date_format(x, "yyyy-MM-dd HH:mm:ss") if dict(df.dtypes)[f].startswith("timestamp") else x.cast("string")
        made = {"rows": F.count(F.lit(1)).cast("string")}
        made |= {f"{n}_{f}": text(g(f), f) for f in fields if f in df.columns for n, g in (("least", F.min), ("most", F.max))}
        made |= {f"distinct_{f}": F.countDistinct(f).cast("string") for f in distinct if f in df.columns}
        made |= {f"total_{f}": F.format_string("%.2f", F.coalesce(total(f), F.lit(0.0)).cast("double")) for f in totals if f in df.columns}
        one = df.agg(*[c.alias(k) for k, c in made.items()])
        each = F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(k).alias("figure")) for k in made])
        return one.select(F.lit(name).alias("table_name"), F.explode(each).alias("x")).select("table_name", "x.statistic", "x.figure")

    return reduce(DataFrame.unionByName, [of(name, df) for name, df in tables.items()])


def batch_log_metrics(lines: DataFrame, text: str = "value") -> DataFrame:
    """One row from a log's start and finish lines: batches, rows, mean and longest duration in seconds."""
    stamp = F.try_to_timestamp(F.regexp_extract(text, r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1))
    event, rows = F.regexp_extract(text, r"batch (start|finish)", 1), F.regexp_extract(text, r"batch (\d+)", 1)
    found = lines.select(stamp.alias("at"), event.alias("event"), F.regexp_extract(text, r"id=(\S+)", 1).alias("batch"), F.regexp_extract(text, r"rows=(\d+)", 1).try_cast("bigint").alias("n")).filter((F.col("event") != "") & (rows == ""))
    each = found.groupBy("batch").agg(F.min(F.when(F.col("event") == "start", F.col("at"))).alias("began"), F.max(F.when(F.col("event") == "finish", F.col("at"))).alias("ended"), F.max("n").alias("n"))
    took = F.unix_timestamp("ended") - F.unix_timestamp("began")
    return each.agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("rows"), F.avg(took).alias("mean_seconds"), F.max(took).alias("most_seconds"))


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and column sums, to compare runs."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"sum_{c}") for c in columns])


def compare_checksums(left: DataFrame, right: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(figure, left, right, same) of two runs' single rows: counts must be equal, sums within a relative tolerance, as the order of additions differs."""
    figures = lambda df: F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in df.columns])
    one = lambda df, side: df.select(F.explode(figures(df)).alias("x")).select("x.figure", F.col("x.value").alias(side))
    whole = [c for c, kind in left.dtypes if kind in ("int", "bigint")]
    near = F.abs(F.col("left") - F.col("right")) <= tolerance * F.greatest(F.abs("left"), F.abs("right"))
    same = F.when(F.col("figure").isin(*whole), F.col("left").eqNullSafe(F.col("right"))).otherwise(F.coalesce(near, F.col("left").isNull() & F.col("right").isNull()))
    return one(left, "left").join(one(right, "right"), "figure", "full").select("figure", "left", "right", F.coalesce(same, F.lit(False)).alias("same"))


def recent_window_report(hours: DataFrame, keys: Sequence[str], ts: str, value: str, n: int = 168) -> DataFrame:
    """Workload: the latest n rows of each entity, summed."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    return hours.withColumn("rn", rn).filter(F.col("rn") <= n).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias(f"sum_{value}"))


def report_workload(hours: DataFrame, keys: Sequence[str], ts: str = "stat_hour") -> DataFrame:
    """One row: how many day reports there are, and their sums."""
    days = hours.groupBy(*keys, F.to_date(ts).alias("stat_date")).agg(
        F.max("supply_kwh").alias("peak"), F.min("supply_kwh").alias("valley"), F.sum("supply_kwh").alias("supply"), F.sum("energy_consumption_kwh").alias("energy"), F.avg("operation_rate").alias("rate"), F.count(F.lit(1)).alias("hours"),
    )
    return days.agg(F.count(F.lit(1)).alias("output_rows"), F.sum("supply").alias("supply_checksum"), F.sum("energy").alias("energy_checksum"), F.max("peak").alias("peak"), F.max("rate").alias("rate"))


def latest_workload(hours: DataFrame, keys: Sequence[str], ts: str = "stat_hour", n: int = 168) -> DataFrame:
    """One row: the latest n hours of every entity, counted and summed."""
    latest = recent_window_report(hours, keys, ts, "supply_kwh", n)
    return latest.agg(F.count(F.lit(1)).alias("output_rows"), F.sum("rows").alias("latest_hours"), F.sum("sum_supply_kwh").alias("supply_checksum"))


def feature_workload(hours: DataFrame, keys: Sequence[str], ts: str = "stat_hour") -> DataFrame:
    """One row: trailing features of every hour that has some."""
    made = windows.trailing(windows.lags(hours, keys, [ts], "supply_kwh", (24,)), keys, [ts], "supply_kwh", (24,)).filter("avg_24 IS NOT NULL")
    return made.agg(F.count(F.lit(1)).alias("output_rows"), F.count("lag_24").alias("lagged_rows"), F.avg("avg_24").alias("rolling_checksum"), F.max("max_24").alias("most"))
