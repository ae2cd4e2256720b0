"""Hourly tables of the three systems in one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions import metrics
from meterflow.functions.scalars import guard, non_negative, running_flag
from meterflow.operators import aggregates, windows
from meterflow.sources.schemas import HOURLY, HOURLY_DOUBLES

# Plausible ranges, largest hourly advances of meters, and points by code.
TEMPERATURE, PRESSURE, FLOW, LOAD = (0, 120), (0, 10), (0, 100_000), (0, 120)
MOST_GAS, MOST_HEAT, MOST_ELECTRIC, MOST_GENERATOR_GAS = 200_000, 200_000, 500_000, 300_000
BOILER_GAS = {"14BOILER_GAS_TOTAL": "14", "23BOILER_GAS_TOTAL": "23"}
CCHP_METERS = {"heating": "FT2005_RL_C", "cooling": "P9_ADDH"}
HEADER_SUPPLY, HEADER_RETURN = "TT2005_T", "TT2004_T"
GENERATOR_METER, GENERATOR_RUN, GENERATOR_GAS = r"^SLG_JZ[0-9]+_DD_YG_ZZ1$", r"^[0-9]+FDJ_RUN$", "FDJ_GAS_TOTAL"


def conform(df: DataFrame, system: str, price_type: str) -> DataFrame:
    """Any system's hours in the unified columns; what it lacks is NULL."""
    known = {"system_type": F.lit(system), "supply_price_type": F.lit(price_type), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    df = df.withColumns(known)
    missing = {c: F.lit(None).cast("double" if c in HOURLY_DOUBLES else "string" if c == "metric_quality" else "bigint") for c in HOURLY if c not in df.columns}
    return df.withColumns(missing | {c: F.col(c).cast("double") for c in HOURLY_DOUBLES if c in df.columns}).select(*HOURLY)


def prepared(fact: DataFrame) -> DataFrame:
    """Facts with their hour, and negative values as NULL."""
    return fact.withColumns({"stat_hour": F.date_trunc("hour", "event_time"), "dt": F.to_date("event_time"), "value_clean": non_negative("value")})


def supply_curve(status: DataFrame, keys: tuple = ("station_id", "equipment_id", "stat_hour", "dt")) -> DataFrame:
    """A chiller's hours from its minutes."""
    status = status.withColumns({"run_flag_clean": running_flag("run_flag"), "stat_hour": F.date_trunc("hour", "stat_minute")})
    wide = ("avg", "max", "min")
    hours = aggregates.rollup(status, keys, {"supply_temp": wide, "return_temp": ("avg",), "pressure": wide, "flow": wide, "power": wide}, [F.max("runtime_hours").alias("cumulative_runtime_hours"), F.max("start_count").alias("start_count"), F.sum("run_flag_clean").alias("running_sample_count")])
    hours = hours.withColumn("runtime_hours", metrics.run_ratio("running_sample_count", "record_count"))
    hours = hours.withColumns({"run_minutes": F.col("runtime_hours") * 60, "operation_rate": F.col("runtime_hours") * 100, "energy_consumption_kwh": metrics.energy("runtime_hours", "avg_power"), "cooling_capacity_kw": metrics.cooling_capacity("runtime_hours", "avg_flow", "avg_supply_temp", "avg_return_temp", "avg_power")})
    return hours.withColumn("cooling_supply_kwh", metrics.cooling_supply("cooling_capacity_kw", "runtime_hours"))


def chiller_hours(curve: DataFrame) -> DataFrame:
    out = curve.withColumns({"energy_input_kwh": F.col("energy_consumption_kwh"), "supply_kwh": F.col("cooling_supply_kwh"), "heating_supply_kwh": F.lit(0.0), "electric_supply_kwh": F.lit(0.0), "metric_quality": F.lit("chiller_status_derived")})
    return conform(out, "chiller", "cooling")


def _ranges(pairs: dict) -> list:
    """avg, max and min of guarded values: {name: (condition, range)}; return temperatures only need the mean."""
    out = []
    for name, (where, bounds) in pairs.items():
        value = guard("value_clean", *bounds, where)
        out += [f(value).alias(f"{stat}_{name}") for stat, f in (("avg", F.avg), ("max", F.max), ("min", F.min)) if stat == "avg" or name != "return_temp"]
    return out


def _by_role(where: Column) -> dict:
    role = F.col("measure_role")
    return {name: (where & (role == name), bounds) for name, bounds in (("supply_temp", TEMPERATURE), ("return_temp", TEMPERATURE), ("pressure", PRESSURE), ("flow", FLOW))}


def heating_hours(fact: DataFrame) -> DataFrame:
    """Each burner's hours: its group's measured gas shared by load, or an estimate from its load. Boilers and burners of one number are
    aggregated together, so the fact is read once for them and once for the gas meters."""
    fact = prepared(fact).withColumn("number", F.regexp_extract("equipment_id", "([0-9]+)$", 1))
    keys, code, v = ["station_id", "number", "stat_hour", "dt"], F.col("point_code"), F.col("value_clean")
    boiler = (F.col("system_type") == "boiler") & F.col("equipment_id").rlike("^boiler_[0-9]+$")
    burner = (F.col("system_type") == "burner") & F.col("equipment_id").rlike("^burner_[0-9]+$")
    state = boiler & ~code.contains("GAS_TOTAL")
    units = fact.filter(state | burner).groupBy(*keys).agg(
        *_ranges(_by_role(state)), F.count_if(state).alias("boiler_records"),
        F.avg(guard("value_clean", *LOAD, burner & code.startswith("Burner_Load_"))).alias("load_pct"),
        F.avg(guard("value_clean", 0, 1, burner & code.startswith("Op_Burner_"))).alias("measured_runtime"),
        F.count_if(burner & code.startswith("Op_Burner_") & (v > 0)).alias("running_sample_count"),
        F.max(F.when(burner & code.startswith("BetrStdB_"), v)).alias("cumulative_runtime_hours"),
        F.count_if(burner).alias("burner_records"),
    )
    units = units.filter("burner_records > 0").withColumn("runtime_hours", metrics.burner_runtime("measured_runtime", "load_pct"))
    units = units.withColumns({"weight": metrics.allocation_weight("runtime_hours", "load_pct"), "gas_group": metrics.gas_group("number")})
    gas = windows.counter_delta(fact.filter(boiler & code.isin(*BOILER_GAS)), ["station_id", "point_code"], "stat_hour", "value_clean", MOST_GAS, "gas_m3")
    gas = gas.select("station_id", "stat_hour", F.when(code == "14BOILER_GAS_TOTAL", "14").otherwise("23").alias("gas_group"), metrics.gas_energy("gas_m3").alias("gas_kwh"), metrics.gas_heat("gas_m3").alias("gas_heat_kwh"))
    out = windows.allocate(units, ["station_id", "gas_group", "stat_hour"], "weight").join(gas, ["station_id", "gas_group", "stat_hour"], "left")
    estimate = F.coalesce(F.col("load_pct"), F.lit(0.0)) / 100 * metrics.HEATING_NOMINAL_KW * F.col("runtime_hours")
    running = F.col("runtime_hours") > 0
    out = out.withColumns({"measured": F.col("gas_heat_kwh") * F.col("share"), "measured_input": F.col("gas_kwh") * F.col("share")})
    out = out.withColumn("heating_supply_kwh", F.coalesce("measured", F.when(running, estimate), F.lit(0.0)))
    out = out.withColumn("energy_consumption_kwh", F.coalesce("measured_input", F.when(running, F.col("heating_supply_kwh") / metrics.BOILER_EFFICIENCY), F.lit(0.0)))
    out = out.withColumns({
        "equipment_id": F.concat(F.lit("heating_"), "number"), "run_minutes": F.col("runtime_hours") * 60, "operation_rate": F.col("runtime_hours") * 100,
        "energy_input_kwh": F.col("energy_consumption_kwh"), "supply_kwh": F.col("heating_supply_kwh"), "cooling_supply_kwh": F.lit(0.0), "electric_supply_kwh": F.lit(0.0),
        "record_count": F.col("boiler_records") + F.col("burner_records"), "metric_quality": metrics.heating_quality(F.col("measured"), F.col("group_weight")),
    })
    return conform(out, "heating", "heating")


def cchp_hours(fact: DataFrame) -> DataFrame:
    """The combined plant's hours from its heat, cooling and electricity meters: one window gives all meters' advances, one aggregation the
    state of the plant and its generators."""
    fact, keys, code = prepared(fact), ["station_id", "stat_hour", "dt"], F.col("point_code")
    plant, generator = F.col("system_type") == "cchp", F.col("system_type") == "generator"
    meters = {
        **{kind: (plant & (code == point), MOST_HEAT) for kind, point in CCHP_METERS.items()},
        "electric": (generator & code.rlike(GENERATOR_METER), MOST_ELECTRIC), "gas": (generator & (code == GENERATOR_GAS), MOST_GENERATOR_GAS),
    }
    named = lambda i: F.coalesce(*[F.when(where, F.lit((kind, most)[i])) for kind, (where, most) in meters.items()])
    rows = fact.withColumns({"meter": named(0), "most": named(1)}).filter(F.col("meter").isNotNull())
    advances = windows.counter_delta(rows, ["station_id", "point_code", "meter", "most"], "stat_hour", "value_clean", F.col("most"))
    total = {kind: F.sum(F.when(F.col("meter") == kind, F.col("delta"))) for kind in meters}
    out = advances.withColumn("dt", F.to_date("stat_hour")).groupBy(*keys).agg(
        *[total[kind].alias(kind) for kind in ("heating", "cooling", "electric")], metrics.gas_energy(total["gas"]).alias("gas_kwh")
    )
    runs = generator & code.rlike(GENERATOR_RUN)
    header = {"header_supply": (plant & (code == HEADER_SUPPLY), TEMPERATURE), "header_return": (plant & (code == HEADER_RETURN), TEMPERATURE)}
    state = fact.filter(plant | runs).groupBy(*keys).agg(
        *_ranges(_by_role(plant) | header), F.avg(guard("value_clean", 0, 1, runs)).alias("generator_runtime"), F.count_if(runs).alias("generator_records"),
        F.count_if(plant).alias("cchp_records"), F.when(F.count_if(runs) > 0, F.count_if(runs & (F.col("value_clean") > 0))).alias("running_sample_count"),
    )
    state = state.withColumns({f"{s}_supply_temp": F.coalesce(f"{s}_header_supply", f"{s}_supply_temp") for s in ("avg", "max", "min")} | {"avg_return_temp": F.coalesce("avg_header_return", "avg_return_temp")})
    out = out.join(state, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns({"heating_supply_kwh": zero("heating"), "cooling_supply_kwh": zero("cooling"), "electric_supply_kwh": zero("electric")})
    out = out.withColumn("supply_kwh", F.col("heating_supply_kwh") + F.col("cooling_supply_kwh") + F.col("electric_supply_kwh"))
    out = out.withColumns({"energy_consumption_kwh": metrics.cchp_input("gas_kwh", "supply_kwh"), "runtime_hours": F.when(F.col("supply_kwh") > 0, 1.0).otherwise(zero("generator_runtime"))})
    out = out.withColumns({
        "equipment_id": F.lit("cchp_system"), "energy_input_kwh": F.col("energy_consumption_kwh"), "run_minutes": F.col("runtime_hours") * 60, "operation_rate": F.col("runtime_hours") * 100, "cooling_capacity_kw": F.col("cooling_supply_kwh"),
        "record_count": F.coalesce("cchp_records", F.lit(0)) + F.coalesce("generator_records", F.lit(0)), "metric_quality": F.lit("cumulative_delta"),
    })
    return conform(out, "cchp", "mixed")


def system_hours(curve: DataFrame, fact: DataFrame) -> DataFrame:
    """All systems' hours."""
    return reduce(DataFrame.unionByName, [chiller_hours(curve), heating_hours(fact), cchp_hours(fact)])
