"""Day, week and month reports from hourly tables: one aggregation over one window, the period as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions import metrics, scalars
from meterflow.operators import aggregates, windows

ENTITY = ["station_id", "system_type", "equipment_id"]
#: Period: (columns that name it, hours that it should have), from an hour column.
PERIODS = {
    "day": (lambda h: {"stat_date": scalars.day_of(h)}, lambda h: F.lit(24.0)),
    "week": (lambda h: {"week_start_date": scalars.week_start(h), "stat_week": scalars.week_label(h)}, lambda h: F.lit(168.0)),
    "month": (lambda h: {"stat_month": scalars.month_label(h)}, lambda h: scalars.hours_in_month(h).cast("double")),
}


def add_period(hours: DataFrame, period: str, hour: str = "stat_hour") -> tuple[DataFrame, list[str]]:
    """The hours with the period's columns and expected_hours, and the names of the period's columns."""
    named, expected = PERIODS[period]
    columns = named(F.col(hour))
    return hours.withColumns(columns | {"expected_hours": expected(F.col(hour))}), list(columns)


def system_report(hours: DataFrame, period: str, prices: DataFrame | None = None, entity: list[str] = ENTITY, hour: str = "stat_hour") -> DataFrame:
    """Peak, valley, totals, durations, ratios and, with one row of prices, cost, revenue and profit by entity and period.

    Peak and valley hours need the period's mean, so the window and the aggregation share one partitioning by entity and period.
    """
    hours, names = add_period(hours, period, hour)
    keys = [*entity, *names]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    hours = hours.withColumns({"supply": zero("supply_kwh"), "cooling": zero("cooling_supply_kwh"), "heating": zero("heating_supply_kwh"), "electric": zero("electric_supply_kwh"), "energy": zero("energy_consumption_kwh"), "minutes": zero("run_minutes")})
    flagged = windows.period_flags(hours, keys, "supply")
    anomaly = (F.col("supply") > 0) & (F.coalesce(F.col("operation_rate"), F.lit(0.0)) <= 0)
    out = flagged.groupBy(*keys).agg(
        F.max("supply").alias("peak_supply_kwh"), F.min(F.when(F.col("supply") > 0, F.col("supply"))).alias("valley_supply_kwh"), F.sum("supply").alias("total_supply_kwh"),
        F.sum("cooling").alias("total_cooling_supply_kwh"), F.sum("heating").alias("total_heating_supply_kwh"), F.sum("electric").alias("total_electric_supply_kwh"),
        F.sum("energy").alias("total_energy_consumption_kwh"), F.sum("minutes").alias("total_run_minutes"), F.avg("supply").alias("avg_supply_kwh"), F.avg("avg_supply_temp").alias("avg_supply_temp"),
        F.avg("operation_rate").alias("avg_operation_rate"), F.count(F.lit(1)).alias("hour_count"), F.count_if(F.col("supply_kwh").isNull()).alias("missing_supply_hours"),
        F.count_if(F.col("energy_consumption_kwh").isNull()).alias("missing_energy_hours"), F.count_if(anomaly).alias("anomaly_count"),
        F.sum("is_peak").alias("peak_duration_hours"), F.sum("is_valley").alias("valley_duration_hours"), F.max("expected_hours").alias("expected_hours"),
    )
    out = out.withColumns({
        "peak_valley_ratio": scalars.safe_div("peak_supply_kwh", "valley_supply_kwh"), "avg_cop": scalars.safe_div("total_supply_kwh", "total_energy_consumption_kwh"), "total_runtime_hours": F.col("total_run_minutes") / 60,
        "equipment_utilization_rate": F.col("total_run_minutes") / (F.col("expected_hours") * 60), "load_factor": scalars.safe_div("avg_supply_kwh", "peak_supply_kwh"), "data_completeness_rate": F.col("hour_count") / F.col("expected_hours"),
    })
    return out if prices is None else priced(out, prices)


def priced(report: DataFrame, prices: DataFrame) -> DataFrame:
    """A report with cost, revenue and profit by one row of prices (electricity_price, cooling_price, heating_price, gas_price)."""
    out = aggregates.with_prices(report, prices)
    revenue = sum(F.col(f"total_{carrier}_supply_kwh") * F.col(f"{price}_price") for carrier, price in (("cooling", "cooling"), ("heating", "heating"), ("electric", "electricity")))
    out = out.withColumn("input_energy_price", metrics.input_price("system_type", "electricity_price", "gas_price"))
    out = out.withColumns({"total_energy_cost": F.col("total_energy_consumption_kwh") * F.col("input_energy_price"), "total_supply_revenue": revenue})
    return out.withColumn("net_profit", F.col("total_supply_revenue") - F.col("total_energy_cost")).drop("electricity_price", "cooling_price", "heating_price", "gas_price")


def chiller_report(curve: DataFrame, period: str, electricity: Column | None = None, cooling: float = metrics.DEFAULT_PRICES["cooling"], entity: list[str] = ["station_id", "equipment_id"]) -> DataFrame:  # noqa: B006
    """A chiller's report with strict totals: unknown as soon as a running hour lacks the figure. The electricity price may
    depend on the hour (a tariff)."""
    curve, names = add_period(curve, period)
    keys = [*entity, *names]
    price = F.lit(metrics.DEFAULT_PRICES["electricity"]) if electricity is None else electricity
    curve = curve.withColumn("hour_cost", F.col("energy_consumption_kwh") * price)
    running, supply = F.col("runtime_hours") > 0, F.col("cooling_supply_kwh")
    out = windows.period_flags(curve, keys, "cooling_supply_kwh").groupBy(*keys).agg(
        F.max(supply).alias("peak_cooling_kwh"), F.min(F.when(supply > 0, supply)).alias("valley_cooling_kwh"), aggregates.strict_total("cooling_supply_kwh", running).alias("total_cooling_supply_kwh"),
        aggregates.strict_total("energy_consumption_kwh", running).alias("total_energy_consumption_kwh"), aggregates.strict_total("hour_cost", running).alias("energy_cost"), F.sum("runtime_hours").alias("total_runtime_hours"),
        F.sum("is_peak").alias("peak_duration_hours"), F.sum("is_valley").alias("valley_duration_hours"), F.count(F.lit(1)).alias("hour_count"), F.max("expected_hours").alias("expected_hours"),
    )
    out = out.withColumns({"avg_cop": scalars.safe_div("total_cooling_supply_kwh", "total_energy_consumption_kwh"), "peak_valley_ratio": scalars.safe_div("peak_cooling_kwh", "valley_cooling_kwh"), "cooling_revenue": F.col("total_cooling_supply_kwh") * cooling, "data_completeness_rate": F.col("hour_count") / F.col("expected_hours")})
    return out.withColumn("net_profit", F.col("cooling_revenue") - F.col("energy_cost"))


def tariff_report(curve: DataFrame, period: str) -> DataFrame:
    """The chiller report with electricity priced by hour of day."""
    return chiller_report(curve, period, scalars.tariff(F.hour("stat_hour")))


#: Weights of the quality score and its thresholds.
COMPLETENESS_WEIGHT, VALIDITY_WEIGHT, GOOD, WARNING = 0.4, 0.6, 80, 60


def data_quality(hours: DataFrame, fields: list[str], running: Column, keys: list[str], expected: int = 24) -> DataFrame:
    """By key (an equipment's day): each field's share of valid hours among running ones, a score and its flag."""
    n = F.count_if(running)
    rates = {f: F.when(n > 0, F.count_if(running & F.col(f).isNotNull()) / n).otherwise(1.0) for f in fields}
    out = hours.groupBy(*keys).agg(F.count(F.lit(1)).alias("hour_count"), *[r.alias(f"{f}_valid_rate") for f, r in rates.items()], *[F.count_if(F.col(f) == 0).alias(f"{f}_zeros") for f in fields], *[F.count_if(F.col(f).isNull()).alias(f"{f}_nulls") for f in fields])
    mean = sum(F.col(f"{f}_valid_rate") for f in fields) / len(fields)
    out = out.withColumn("completeness", F.least(F.col("hour_count") / expected, F.lit(1.0)))
    out = out.withColumn("quality_score", (COMPLETENESS_WEIGHT * F.col("completeness") + VALIDITY_WEIGHT * mean) * 100)
    return out.withColumn("quality_flag", F.when(F.col("quality_score") >= GOOD, "good").when(F.col("quality_score") >= WARNING, "warning").otherwise("poor"))


def across_equipment(report: DataFrame, keys: list[str]) -> DataFrame:
    """A report's rows of all equipment together: totals summed, peaks and valleys taken, ratios made anew."""
    out = report.groupBy(*keys).agg(
        F.countDistinct("equipment_id").alias("equipment"), F.sum("total_supply_kwh").alias("total_supply_kwh"), F.sum("total_energy_consumption_kwh").alias("total_energy_consumption_kwh"), F.max("peak_supply_kwh").alias("peak_supply_kwh"),
        F.min(F.when(F.col("valley_supply_kwh") > 0, F.col("valley_supply_kwh"))).alias("valley_supply_kwh"), F.sum("hour_count").alias("hour_count"),
    )
    return out.withColumns({"peak_valley_ratio": scalars.safe_div("peak_supply_kwh", "valley_supply_kwh"), "mean_supply_kwh": scalars.safe_div("total_supply_kwh", "hour_count"), "cop": scalars.safe_div("total_supply_kwh", "total_energy_consumption_kwh")})
