"""Window operators on time series. Every window is partitioned by the series' key; ties in time break by further order columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions.scalars import col

Keys = Sequence[str]
# Themes that are carried forward, themes of meters, longest gap of a continuous series and age of a status, in seconds.
CONTINUOUS_THEMES = ["temperature", "pressure", "flow", "power"]
METER_THEMES = ["cumulative", "runtime"]
LONG_GAP_S, STALE_STATUS_S = 300, 3600


def series(keys: Keys, order: Keys, descending: bool = False) -> Window:
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) if descending else F.asc(c) for c in order])


def seconds_since_last(df: DataFrame, keys: Keys, ts: str, order: Keys = (), name: str = "gap_s") -> DataFrame:
    """Adds the seconds since the series' previous row."""
    before = F.lag(ts).over(series(keys, [ts, *order]))
    return df.withColumn(name, F.unix_timestamp(ts) - F.unix_timestamp(before))


def fill_gaps(df: DataFrame, keys: Keys, ts: str, value: str, theme: str, order: Keys = (), continuous: Sequence[str] = tuple(CONTINUOUS_THEMES), longest: int = LONG_GAP_S, mode: str = "last_row", name: str = "filled") -> DataFrame:
    """Fill NULL values by theme: a status from the row before, a continuous theme only over a short gap.

    ``last_row`` takes the previous row's value, even if it is NULL; ``carry`` takes the last known one. Adds gap_s too.
    """
    df = seconds_since_last(df, keys, ts, order)
    w = series(keys, [ts, *order])
    before = F.lag(value).over(w) if mode == "last_row" else F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    may = (F.col(theme) == "status") | (F.col(theme).isin(*continuous) & (F.col("gap_s") <= longest))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.col(value)).when(may, before))


def quality_flag(value, theme, gap, meters: Sequence[str] = tuple(METER_THEMES), longest: int = LONG_GAP_S, stale: int = STALE_STATUS_S) -> Column:
    """By precedence: long_missing (of any theme), cumulative_gap (a meter's), status_stale, normal. value: before any filling."""
    value, theme, gap = col(value), col(theme), col(gap)
    return (
        F.when(value.isNull() & (gap > longest), "long_missing")
        .when(theme.isin(*meters) & value.isNull(), "cumulative_gap")
        .when((theme == "status") & (gap > stale), "status_stale")
        .otherwise("normal")
    )


def latest_per_key(df: DataFrame, keys: Keys, order: Keys, n: int = 1) -> DataFrame:
    """The last n rows of each key by the order columns, newest first as rn."""
    ranked = df.withColumn("rn", F.row_number().over(series(keys, order, descending=True))).filter(F.col("rn") <= n)
    return ranked.drop("rn") if n == 1 else ranked


def counter_delta(df: DataFrame, keys: Keys, bucket: str, value: str, most: float | Column, name: str = "delta") -> DataFrame:
    """A meter's advance between consecutive buckets that have readings; NULL on a reset, a jump above most (a number, or a column of the keys), or the first."""
    ends = df.groupBy(*keys, bucket).agg(F.max(value).alias("reading"))
    advance = F.col("reading") - F.lag("reading").over(series(keys, [bucket]))
    return ends.withColumn(name, F.when(advance.between(0, most), advance))


def allocate(df: DataFrame, group: Keys, weight: str, total: str | None = None, name: str = "share") -> DataFrame:
    """Adds each row's share of its group by weight (equal parts if no weight is positive), and its part of the total."""
    w = Window.partitionBy(*group)
    whole = F.sum(weight).over(w)
    df = df.withColumn("group_weight", whole).withColumn(name, F.when(F.col("group_weight") > 0, F.col(weight) / F.col("group_weight")).otherwise(1.0 / F.count(F.lit(1)).over(w)))
    return df if total is None else df.withColumn("allocated", F.col(total) * F.col(name))


def period_flags(df: DataFrame, keys: Keys, value: str, high: float = 1.2, low: float = 0.8) -> DataFrame:
    """Adds is_peak (above high times the period's mean) and is_valley (positive and below low times the mean)."""
    mean = F.avg(value).over(Window.partitionBy(*keys))
    v = F.col(value)
    return df.withColumn("period_mean", mean).withColumns({"is_peak": (v > F.col("period_mean") * high).cast("int"), "is_valley": ((v > 0) & (v < F.col("period_mean") * low)).cast("int")})


def lags(df: DataFrame, keys: Keys, order: Keys, value: str, steps: Sequence[int] = (1, 24, 168), prefix: str = "lag_") -> DataFrame:
    w = series(keys, order)
    return df.withColumns({f"{prefix}{k}": F.lag(value, k).over(w) for k in steps})


def trailing(df: DataFrame, keys: Keys, order: Keys, value: str, sizes: Sequence[int] = (24, 168), stats: Sequence[str] = ("avg", "max"), current: bool = False) -> DataFrame:
    """Statistics of the last rows, without the current one by default; a standard deviation needs two rows."""
    made = {"avg": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}
    out = {}
    for n in sizes:
        w = series(keys, order).rowsBetween(-n + 1 if current else -n, 0 if current else -1)
        out |= {f"{s}_{n}": made[s](value).over(w) for s in stats}
    return df.withColumns(out)


def differences(df: DataFrame, keys: Keys, order: Keys, value: str, steps: Sequence[int] = (1, 24)) -> DataFrame:
    """Adds diff_k and pct_change_k against k rows before; NULL where that is 0 or missing."""
    w, out = series(keys, order), {}
    for k in steps:
        before = F.lag(value, k).over(w)
        out[f"diff_{k}"] = F.col(value) - before
        out[f"pct_change_{k}"] = F.try_divide(F.col(value) - before, before)
    return df.withColumns(out)


def chronological_split(df: DataFrame, keys: Keys, order: Keys, share: float = 0.8, least_train: int = 0, least_test: int = 0) -> DataFrame:
    """Adds is_train for the first share of each series; series with too few rows on either side go."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = df.withColumn("n_rows", n).withColumn("n_train", F.floor(F.col("n_rows") * share)).withColumn("is_train", F.row_number().over(series(keys, order)) <= F.col("n_train"))
    return df.filter((F.col("n_train") >= least_train) & (F.col("n_rows") - F.col("n_train") >= least_test)).drop("n_rows", "n_train")


def clean_series(df: DataFrame, keys: Keys, order: Keys, values: Sequence[str]) -> DataFrame:
    """NULLs from the last known value, else from the next one, else 0; values that aren't finite become 0."""
    back, ahead = series(keys, order).rowsBetween(Window.unboundedPreceding, 0), series(keys, order).rowsBetween(0, Window.unboundedFollowing)
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    df = df.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c)) for c in values})
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead), F.lit(0.0)) for c in values})


def hour_grid(df: DataFrame, keys: Keys, hour: str) -> DataFrame:
    """Every hour between each series' first and last, with its row or NULLs."""
    spans = df.groupBy(*keys).agg(F.explode(F.sequence(F.min(hour), F.max(hour), F.expr("INTERVAL 1 HOUR"))).alias(hour))
    return spans.join(df, [*keys, hour], "left")
