"""Dashboard figures as DataFrames: snapshots, roll-ups, trends, KPIs, theme and device statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions import metrics
from meterflow.functions.scalars import safe_div
from meterflow.operators import windows

ENTITY = ["system_type", "equipment_id"]


def status(records, supply, rate, cop=None, least_records: int = 3, least_cop: float = 0.5) -> Column:
    """nodata, stopped, warning (few records, or with a COP a low one), running."""
    warn = F.col(records) < least_records
    if cop is not None:
        warn = warn | F.coalesce(F.col(cop) < least_cop, F.lit(False))
    idle = (F.coalesce(F.col(supply), F.lit(0.0)) <= 0) & (F.coalesce(F.col(rate), F.lit(0.0)) <= 0)
    return F.when(F.coalesce(F.col(records), F.lit(0)) == 0, "nodata").when(idle, "stopped").when(warn, "warning").otherwise("running")


def snapshot(hours: DataFrame, keys: list[str] = ENTITY, ts: str = "stat_hour") -> DataFrame:
    """Each equipment's latest hour with status and efficiency."""
    last = windows.latest_per_key(hours, keys, [ts])
    last = last.withColumn("supply", metrics.primary_supply("supply_kwh", "cooling_supply_kwh", "heating_supply_kwh", "electric_supply_kwh"))
    return last.select(*keys, ts, "supply", F.col("energy_consumption_kwh").alias("energy"), safe_div("supply", "energy_consumption_kwh").alias("efficiency"), status("record_count", "supply", "operation_rate").alias("status"))


def by_system(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("system_type").agg(F.count(F.lit(1)).alias("equipment_count"), F.count_if(F.col("status") == "running").alias("running_count"), F.count_if(F.col("status") == "warning").alias("warning_count"), F.sum("supply").alias("total_supply"), F.sum("energy").alias("total_energy"))


def trend(hours: DataFrame, unit: str = "hour", n: int = 24, ts: str = "stat_hour") -> DataFrame:
    """Totals of the latest n hours or days that have data."""
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)))
    totals = hours.groupBy(F.date_trunc(unit, ts).alias("period")).agg(zero("supply_kwh").alias("supply"), zero("energy_consumption_kwh").alias("energy"))
    return totals.orderBy(F.desc("period")).limit(n)


def forecast_totals(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("forecast_hour_offset").agg(*[F.sum(c).alias(f"total_{c}") for c in ("predicted_supply_kwh", "confidence_lower", "confidence_upper")])


def profit_scope(revenue: DataFrame, value: str, scopes: list[Column]) -> DataFrame:
    """One row: the sum within the first scope that has rows."""
    return revenue.agg(F.coalesce(*[F.sum(F.when(s, F.col(value))) for s in scopes]).alias("profit"))


def kpis(snapshot: DataFrame) -> DataFrame:
    online = F.count_if(F.col("status").isin("running", "warning"))
    total = F.count(F.lit(1))
    return snapshot.agg(total.alias("equipment"), online.alias("online"), F.sum("supply").alias("supply"), F.sum("energy").alias("energy"), safe_div(F.sum("supply"), F.sum("energy")).alias("efficiency"), (safe_div(online, total) * 100).alias("health_score"), F.avg(F.when(F.col("efficiency") > 0, F.col("efficiency"))).alias("mean_positive_cop"))


def theme_stats(hours: DataFrame, themes: dict[str, str], keys: list[str] = ENTITY) -> DataFrame:
    """For each theme (and its column) and equipment: records, total, mean, max, min and positive records."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.col(c).cast("double").alias("value")) for t, c in themes.items()]))
    long = hours.select(*keys, each.alias("x")).select(*keys, "x.theme", "x.value").filter("value IS NOT NULL")
    return long.groupBy(*keys, "theme").agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.min("value").alias("least"), F.count_if(F.col("value") > 0).alias("positive"))


def aligned_grid(hours: DataFrame, by: str, values: list[str], value: str, ts: str = "stat_hour") -> DataFrame:
    """Every hour that any series has, a column for each series."""
    return hours.groupBy(ts).pivot(by, values).agg(F.max(value))


def device_stats(status_rows: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """By device: rows, running rows, means, and the share of rows with all fields."""
    valid = F.lit(True)
    for f in fields:
        valid = valid & F.col(f).isNotNull()
    return status_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("run_flag") > 0).alias("running_rows"), *[F.avg(f).alias(f"mean_{f}") for f in fields], (F.count_if(valid) * 100.0 / F.count(F.lit(1))).alias("quality_pct"))


def totals_and_margin(revenue: DataFrame, keys: list[str]) -> DataFrame:
    return revenue.groupBy(*keys).agg(F.sum("predicted_supply_revenue").alias("revenue"), F.sum("predicted_energy_cost").alias("cost"), F.sum("predicted_profit").alias("profit"), F.avg("profit_margin").alias("mean_margin"))


def price_grid(prices: DataFrame, types: list[str], date: str, kind: str, price: str) -> DataFrame:
    return prices.groupBy(date).pivot(kind, types).agg(F.avg(price))


def top_equipment(hours: DataFrame, n: int = 8, keys: list[str] = ENTITY, value: str = "supply_kwh") -> DataFrame:
    return hours.groupBy(*keys).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), *keys).limit(n)


def available_dates(df: DataFrame, date: str, until, n: int) -> DataFrame:
    """The last n dates with data up to a day."""
    return df.select(date).distinct().filter(F.col(date) <= F.lit(until)).orderBy(F.desc(date)).limit(n)
