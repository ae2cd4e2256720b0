"""Operating advice: metrics by equipment, and rules as data that compile to columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.operators import windows

KEYS = ["station_id", "equipment_id"]


def current_metrics(hours: DataFrame, reports: DataFrame, ts: str = "stat_hour", keys: list[str] = KEYS) -> DataFrame:
    """By equipment: means of the last 6 hours, starts and high-load hours of the last 24, the latest COP, and how many units of
    the station run."""
    ranked = hours.withColumn("rn", F.row_number().over(windows.series(keys, [ts], descending=True))).filter("rn <= 24")
    six, rate = F.col("rn") <= 6, F.coalesce("operation_rate", F.lit(0.0))
    mean = lambda c: F.avg(F.when(six, F.col(c)))
    out = ranked.groupBy(*keys).agg(
        F.coalesce(mean("cooling_supply_kwh"), F.lit(0.0)).alias("avg_cooling_6h"), F.coalesce(mean("operation_rate"), F.lit(0.0)).alias("operation_rate"), mean("avg_supply_temp").alias("avg_supply_temp"),
        mean("avg_return_temp").alias("avg_return_temp"), F.max(F.when(F.col("rn") == 1, (rate > 0).cast("int"))).alias("run_flag"),
        F.coalesce(F.max("start_count") - F.min("start_count"), F.lit(0.0)).alias("start_count_24h"), F.count_if(rate >= 95).alias("high_load_hours"),
    )
    running = F.sum("run_flag").over(Window.partitionBy(keys[0]))
    cop = reports.groupBy(*keys).agg(F.max_by("avg_cop", "stat_date").alias("avg_cop"))
    return out.withColumn("running_units", running).join(cop, keys, "left")


def forecast_metrics(forecast: DataFrame, keys: list[str] = KEYS, n: int = 6) -> DataFrame:
    """The mean of the next n predicted hours."""
    first = forecast.withColumn("rn", F.row_number().over(windows.series(keys, ["target_hour"]))).filter(F.col("rn") <= n)
    return first.groupBy(*keys).agg(F.avg("predicted_cooling_kwh").alias("forecast_cooling_6h"))


@dataclass(frozen=True)
class Rule:
    """evidence: name, column and decimals of what the text shows."""

    rule_id: str
    advice_type: str
    risk_level: str
    condition: Column
    text: str
    evidence: list[tuple[str, Column, int]]

    def hit(self) -> Column:
        shown = F.struct(*[F.round(c.cast("double"), n).alias(name) for name, c, n in self.evidence])
        said = F.format_string(self.text, *[F.round(c.cast("double"), n) for _, c, n in self.evidence])
        return F.when(self.condition, F.struct(F.lit(self.rule_id).alias("rule_id"), F.lit(self.advice_type).alias("advice_type"), F.lit(self.risk_level).alias("risk_level"), said.alias("advice_text"), F.to_json(shown).alias("evidence_metrics")))


def rules() -> list[Rule]:
    """The six rules' thresholds, types and risks."""
    now, then, units, rate = F.col("avg_cooling_6h"), F.coalesce("forecast_cooling_6h", F.lit(0.0)), F.col("running_units"), F.col("operation_rate")
    difference = F.col("avg_return_temp") - F.col("avg_supply_temp")
    change = F.when(now > 0, (then / now - 1) * 100)
    load = [("predicted_cooling_kwh", then, 2), ("current_cooling_kwh", now, 2), ("change_pct", change, 1), ("running_units", units, 0)]
    return [
        Rule("R001", "load_change", "medium", (now > 0) & (then < now * 0.7) & (units >= 2), "load falls to %s kWh from %s kWh (%s %%) with %s units running: stop one", load),
        Rule("R002", "load_change", "high", (now > 0) & (then > now * 1.3) & (units < 3), "load rises to %s kWh from %s kWh (%s %%) with %s units running: start a spare one", load),
        Rule("R003", "anomaly", "high", (F.col("run_flag") > 0) & ((difference < 3) | (difference > 8)), "temperature difference of supply %s and return %s is %s, not 3 to 8: check sensors", [("supply_temp", F.col("avg_supply_temp"), 2), ("return_temp", F.col("avg_return_temp"), 2), ("temp_diff", difference, 2)]),
        Rule("R004", "efficiency", "medium", (F.col("avg_cop") < 2.5) & (rate > 50), "COP %s is below 2.5 at an operation rate of %s %%: maintain", [("avg_cop", F.col("avg_cop"), 2), ("operation_rate", rate, 1)]),
        Rule("R005", "efficiency", "medium", F.col("start_count_24h") > 10, "%s starts in 24 hours, more than 10: check the control", [("start_count_24h", F.col("start_count_24h"), 0)]),
        Rule("R006", "efficiency", "high", (rate > 95) & (F.col("high_load_hours") > 6), "operation rate %s %% with %s hours of full load: share the load", [("operation_rate", rate, 1), ("high_load_hours", F.col("high_load_hours"), 1)]),
    ]


def advise(metrics: DataFrame, made: list[Rule] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """A row for each rule that an equipment's metrics meet."""
    hits = F.array_compact(F.array(*[r.hit() for r in made or rules()]))
    return metrics.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*", F.lit(True).alias("is_active"))


def by_risk(advice: DataFrame) -> DataFrame:
    return advice.groupBy("risk_level").agg(F.count(F.lit(1)).alias("rows"))


def catalogue(spark: SparkSession, made: list[Rule] | None = None) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.advice_type, r.risk_level) for r in made or rules()], "rule_id string, advice_type string, risk_level string")


#: How many suppliers and rows of dashboard advice are shown.
TOP_SUPPLIERS, MOST_ADVICE = 3, 8


def dashboard_advice(equipment: DataFrame, systems: DataFrame, revenue_total: DataFrame) -> DataFrame:
    """Ordered rows of advice for a dashboard: idle or inefficient systems, the main suppliers, a negative profit, else all well.

    equipment: system_type, equipment_id, status, supply, efficiency; systems: system_type, running_count, total_supply,
    total_energy; revenue_total: one row with revenue.
    """
    row = lambda rank, kind, risk, text: [F.lit(rank).alias("rank"), F.lit(kind).alias("advice_type"), F.lit(risk).alias("risk_level"), text.alias("advice_text")]
    who = lambda c: [F.col("system_type"), c.alias("equipment_id")]
    idle = (F.col("running_count") == 0) & (F.col("total_supply") <= 0)
    weak = ~idle & (F.col("total_energy") > 0) & (F.col("total_supply") / F.col("total_energy") < 1)
    one = systems.filter(idle).select(*who(F.lit("system")), *row(1, "operation_status", "low", F.lit("not running and without supply")))
    two = systems.filter(weak).select(*who(F.lit("system")), *row(2, "efficiency", "medium", F.lit("supply is less than the energy used")))
    top = equipment.filter("status = 'running'").orderBy(F.desc("supply"), "equipment_id").limit(TOP_SUPPLIERS)
    three = top.select(*who(F.col("equipment_id")), *row(3, "dispatch", "low", F.format_string("supplies %s kWh", F.round("supply", 1))))
    four = revenue_total.filter("revenue < 0").select(F.lit(None).cast("string").alias("system_type"), F.lit("revenue").alias("equipment_id"), *row(4, "economic", "medium", F.format_string("expected profit is %s", F.round("revenue", 1))))
    found = one.unionByName(two).unionByName(three).unionByName(four)
    well = revenue_total.select(F.lit(None).cast("string").alias("system_type"), F.lit("system").alias("equipment_id"), *row(5, "normal", "low", F.lit("all systems run steadily")))
    none = well.join(found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"), how="left_semi")
    return found.unionByName(none).orderBy("rank", "system_type", "equipment_id").limit(MOST_ADVICE)
