"""Features, seasonal forecasts, forecast frames, evaluation and revenue."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions import metrics, scalars
from meterflow.operators import aggregates, joins, windows

ENTITY = ["system_type", "equipment_id"]
#: Two-sided z quantiles by confidence.
Z = {0.80: 1.2816, 0.90: 1.6449, 0.95: 1.9600}


def calendar_features(df: DataFrame, ts: str = "stat_hour") -> DataFrame:
    """month, day_of_month, day_of_week (Monday 0), hour, is_weekend, season, and sines and cosines of hour, day and month."""
    hour, dow, month = F.hour(ts), F.weekday(ts), F.month(ts)
    season = F.when(month.isin(12, 1, 2), 0).when(month.isin(3, 4, 5), 1).when(month.isin(6, 7, 8), 2).otherwise(3)
    wave = lambda x, n: {"sin": F.sin(x * (2 * math.pi / n)), "cos": F.cos(x * (2 * math.pi / n))}
    waves = {f"{name}_{w}": c for name, x, n in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)) for w, c in wave(x, n).items()}
    return df.withColumns({"month": month, "day_of_month": F.dayofmonth(ts), "day_of_week": dow, "hour_of_day": hour, "is_weekend": (dow >= 5).cast("int"), "season": season} | waves)


def signed_difference(df: DataFrame, name: str = "temp_difference") -> DataFrame:
    """Return less supply for cooling, supply less return for the others; a missing one counts as 0."""
    supply, back = F.coalesce("avg_supply_temp", F.lit(0.0)), F.coalesce("avg_return_temp", F.lit(0.0))
    return df.withColumn(name, F.when(F.col("system_type") == "chiller", back - supply).otherwise(supply - back))


def training_features(hours: DataFrame, value: str = "supply_kwh", ts: str = "stat_hour", keys: list[str] = ENTITY) -> DataFrame:
    """Calendar, lag, trailing and difference features and the covariates, NULLs as 0. All windows share one partitioning and order."""
    out = signed_difference(calendar_features(hours, ts)).withColumn("date_type", F.col("is_weekend"))
    out = windows.trailing(windows.lags(out, keys, [ts], value), keys, [ts], value)
    made = ["temp_difference", "lag_1", "lag_24", "lag_168", "avg_24", "max_24", "avg_168", "max_168"]
    return out.na.fill(0.0, made + covariates(hours))


#: Measured features; a future hour takes their mean of its hour of day.
COVARIATES = ["avg_supply_temp", "avg_return_temp", "avg_pressure", "avg_flow", "avg_power", "operation_rate"]


def covariates(hours: DataFrame) -> list[str]:
    """Those of COVARIATES that the hourly table has."""
    return [c for c in COVARIATES if c in hours.columns]


def features(hours: DataFrame) -> list[str]:
    """The features of a model on the hourly table."""
    return FEATURES + covariates(hours)


FEATURES = ["month", "day_of_week", "hour_of_day", "is_weekend", "date_type", "season", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "temp_difference", "lag_1", "lag_24", "lag_168", "avg_24", "max_24", "avg_168", "max_168"]


def feature_columns(df: DataFrame, target: str, without: list[str]) -> list[str]:
    """Numeric columns that are neither the target nor excluded."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in numeric and c != target and c not in without]


def prepare_training(df: DataFrame, target: str, without: list[str], keys: list[str] = ENTITY, ts: str = "stat_hour") -> tuple[DataFrame, list[str]]:
    """Rows with a target and clean features, and the features' names."""
    names = feature_columns(df, target, without)
    known = df.filter(F.col(target).isNotNull())
    doubles = known.withColumns({c: F.col(c).cast("double") for c in names})
    return windows.clean_series(doubles, keys, [ts], names), names


def future_hours(df: DataFrame, keys: list[str], ts: str, n: int = 24) -> DataFrame:
    """The n hours after each entity's last one."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("last_hour"))
    out = last.withColumn("forecast_hour_offset", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return out.withColumn("target_hour", F.col("last_hour") + F.make_dt_interval(F.lit(0), F.col("forecast_hour_offset")))


def future_features(hours: DataFrame, keys: list[str] = ENTITY, ts: str = "stat_hour", value: str = "supply_kwh", n: int = 24) -> DataFrame:
    """For every future hour the actual value 1, 24 and 168 hours before where known, else the latest, the trailing figures up to
    the latest hour, and the covariates' means of its hour of day with their temperature difference (0 where there are none)."""
    trailing = windows.trailing(hours, keys, [ts], value, current=True)
    figures = ["avg_24", "max_24", "avg_168", "max_168"]
    latest = windows.latest_per_key(trailing, keys, [ts]).select(*keys, F.col(value).alias("latest"), *[F.coalesce(c, value).alias(c) for c in figures])
    known = covariates(hours)
    profile = hours.groupBy(*keys, F.hour(ts).alias("hour_of_day")).agg(*[F.avg(c).alias(c) for c in known], F.count(F.lit(1)).alias("_n")).drop("_n")
    out = future_hours(hours, keys, ts, n).withColumnRenamed("target_hour", ts)
    out = joins.at_offset(out, hours, keys, ts, value, (1, 24, 168)).join(latest, keys, "left")
    out = calendar_features(out.withColumns({f"lag_{h}": F.coalesce(f"at_{h}", "latest") for h in (1, 24, 168)}), ts).withColumn("date_type", F.col("is_weekend"))
    out = out.join(profile, [*keys, "hour_of_day"], "left")
    out = signed_difference(out).na.fill(0.0, ["temp_difference", *known]) if {"avg_supply_temp", "avg_return_temp", "system_type"} <= {*known, *keys} else out
    return out.drop("at_1", "at_24", "at_168").withColumnRenamed(ts, "target_hour")


#: Half widths of the seasonal forecast's band, with enough samples and without.
MARGIN, WIDE_MARGIN, ENOUGH = 0.15, 0.25, 8


def seasonal_forecast(hours: DataFrame, n: int = 24, keys: list[str] = ENTITY, ts: str = "stat_hour") -> DataFrame:
    """Mean of the same hour and weekday, else of the hour, else of all, split by the past mix of carriers, with a band."""
    past = hours.withColumns({"supply": F.coalesce("supply_kwh", F.lit(0.0)), "hour_of_day": F.hour(ts), "day_of_week": F.dayofweek(ts)})
    profiles = aggregates.seasonal_profiles(past, keys, ["hour_of_day", "day_of_week"], "supply")
    level = lambda depth, cols, name: profiles.filter(F.col("depth") == depth).select(*keys, *cols, F.col("mean_value").alias(name), F.col("samples").alias(f"{name}_samples"))
    fine, by_hour, overall = level(2, ["hour_of_day", "day_of_week"], "fine"), level(1, ["hour_of_day"], "hourly"), level(0, [], "overall")
    parts = ["cooling_supply_kwh", "heating_supply_kwh", "electric_supply_kwh", "energy_consumption_kwh"]
    shares = aggregates.mix_shares(past, keys, "supply", parts)
    out = future_hours(past, keys, ts, n).withColumns({"hour_of_day": F.hour("target_hour"), "day_of_week": F.dayofweek("target_hour")})
    out = out.join(fine, [*keys, "hour_of_day", "day_of_week"], "left").withColumnRenamed("fine_samples", "profile_sample_count")
    out = joins.cascade(out, [(by_hour, [*keys, "hour_of_day"], "hourly"), (overall, keys, "overall")], "coarse")
    out = out.withColumn("predicted_supply_kwh", F.coalesce("fine", "coarse")).drop("fine", "coarse")
    out = out.join(shares, keys, "left")
    p = F.col("predicted_supply_kwh")
    out = out.withColumns({f"predicted_{c}_kwh": p * F.col(f"{x}_share") for c, x in (("cooling", parts[0]), ("heating", parts[1]), ("electric", parts[2]), ("energy", parts[3]))})
    margin = p * F.when(F.col("profile_sample_count") >= ENOUGH, MARGIN).otherwise(WIDE_MARGIN)
    out = out.withColumns({"confidence_lower": F.greatest(p - margin, F.lit(0.0)), "confidence_upper": p + margin})
    return out.drop(*[f"{x}_share" for x in parts], "hour_of_day", "day_of_week", "last_hour")


def band(df: DataFrame, prediction: str, spread: Column | str, z: float = Z[0.80]) -> DataFrame:
    """A confidence band of z spreads around the prediction, not below 0."""
    s = scalars.col(spread) * z
    return df.withColumns({"confidence_lower": F.greatest(F.col(prediction) - s, F.lit(0.0)), "confidence_upper": F.col(prediction) + s})


def fixed_band(df: DataFrame, prediction: str, share: float = 0.15) -> DataFrame:
    return band(df, prediction, F.col(prediction) * share, 1.0)


def evaluate(df: DataFrame, keys: list[str], actual: str, prediction: str) -> DataFrame:
    """MAE, RMSE, R2, MAPE in % of positive actuals, and the residuals' deviation, for all entities at once."""
    a, e = F.col(actual), F.col(actual) - F.col(prediction)
    out = df.filter(a.isNotNull() & F.col(prediction).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.when(a > 0, F.abs(e) / a)) * 100).alias("mape"),
        F.stddev_pop(e).alias("residual_std"), F.sum(e * e).alias("_sse"), F.var_pop(a).alias("_var"),
    )
    return out.withColumn("r2", 1 - scalars.safe_div("_sse", F.col("_var") * F.col("n"))).drop("_sse", "_var")


def recent_activity(hours: DataFrame, keys: list[str] = ENTITY, ts: str = "stat_hour", n: int = 24, least: float = 1e-6) -> DataFrame:
    """Whether an entity has supplied or run in its last n hours, and what that means for its forecast."""
    last = windows.latest_per_key(hours, keys, [ts], n)
    out = last.groupBy(*keys).agg(F.sum(F.coalesce("supply_kwh", F.lit(0.0))).alias("recent_supply_kwh"), F.avg(F.coalesce("operation_rate", F.lit(0.0))).alias("recent_operation_rate"))
    idle = (F.col("recent_supply_kwh") <= least) & (F.col("recent_operation_rate") <= least)
    return out.withColumns({"activity": F.when(idle, "inactive").otherwise("active"), "interpretation": F.when(idle, "no supply in the last hours: a forecast near zero is expected").otherwise("recent supply: the forecast continues it")})


def revenue(forecast: DataFrame, prices: DataFrame) -> DataFrame:
    """Revenue by carrier, cost of the input energy, profit and margin. Electricity is sold at its own price."""
    out = aggregates.with_prices(forecast, prices).withColumn("energy_price", metrics.input_price("system_type", "electricity_price", "gas_price"))
    sold = F.col("predicted_cooling_kwh") * F.col("cooling_price") + F.col("predicted_heating_kwh") * F.col("heating_price") + F.col("predicted_electric_kwh") * F.col("electricity_price")
    out = out.withColumns({"predicted_supply_revenue": sold, "predicted_energy_cost": F.col("predicted_energy_kwh") * F.col("energy_price")})
    out = out.withColumn("predicted_profit", F.col("predicted_supply_revenue") - F.col("predicted_energy_cost"))
    return out.withColumn("profit_margin", F.coalesce(scalars.safe_div("predicted_profit", "predicted_supply_revenue"), F.lit(0.0)))


def cooling_revenue(forecast: DataFrame, cooling_price: float = metrics.DEFAULT_PRICES["cooling"], cop: float = metrics.LEGACY_COP) -> DataFrame:
    """Cooling alone: electricity by tariff, energy by a fixed efficiency."""
    out = forecast.withColumns({"electricity_price": scalars.tariff(F.hour("target_hour")), "predicted_energy_kwh": F.col("predicted_cooling_kwh") / cop})
    out = out.withColumns({"predicted_revenue": F.col("predicted_cooling_kwh") * cooling_price, "predicted_cost": F.col("predicted_energy_kwh") * F.col("electricity_price")})
    return out.withColumn("predicted_profit", F.col("predicted_revenue") - F.col("predicted_cost"))


def metrics_from_forecast(forecast: DataFrame, keys: list[str] = ENTITY) -> DataFrame:
    """Where no metrics are stored: for each entity what its first forecast row tells."""
    first = windows.latest_per_key(forecast.withColumn("_back", -F.col("forecast_hour_offset")), keys, ["_back"])
    width = F.col("confidence_upper") - F.col("confidence_lower")
    return first.select(*keys, F.col("target_hour").alias("first_hour"), "predicted_supply_kwh", (width / 2).alias("half_width"), F.lit("from_forecast").alias("metrics_source"))
