"""Grouping operators: pivots, roll-ups, period reports, strict totals, profiles and coverage counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions.scalars import safe_div

Keys = Sequence[str]


def conditional_pivot(df: DataFrame, keys: Keys, value: str, columns: dict[str, Column], agg=F.max) -> DataFrame:
    """Long to wide in one aggregation: a column for each condition, and record_count."""
    return df.groupBy(*keys).agg(*[agg(F.when(where, F.col(value))).alias(name) for name, where in columns.items()], F.count(F.lit(1)).alias("record_count"))


def rollup(df: DataFrame, keys: Keys, stats: dict[str, Sequence[str]], extra: Sequence[Column] = ()) -> DataFrame:
    """stats: for each value the statistics wanted, named stat_value; record_count is added."""
    made = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    return df.groupBy(*keys).agg(*[made[s](v).alias(f"{s}_{v}") for v, wanted in stats.items() for s in wanted], *extra, F.count(F.lit(1)).alias("record_count"))


def pivot_listed(df: DataFrame, keys: Keys, by: str, values: Sequence[str], value: str, agg=F.sum) -> DataFrame:
    return df.groupBy(*keys).pivot(by, list(values)).agg(agg(value))


def price_row(prices: DataFrame, type_col: str, price_col: str, defaults: dict[str, float]) -> DataFrame:
    """One row: the mean price of each type, or its default."""
    mean = lambda t: F.avg(F.when(F.col(type_col) == t, F.col(price_col)))
    return prices.agg(*[F.coalesce(mean(t), F.lit(d)).alias(f"{t}_price") for t, d in defaults.items()])


def with_prices(df: DataFrame, row: DataFrame) -> DataFrame:
    """Every row of df with the one row of prices (NULLs if it has none); more rows are an error. What is broadcast is an aggregate's single row."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one row of prices"))).otherwise(F.lit(1)).alias("_one")
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.agg(one, *[F.first(c).alias(c) for c in row.columns])), "_one").drop("_one")


def strict_total(value: str, running: Column) -> Column:
    """The sum; NULL if any running row lacks the value, 0 if none has one."""
    return F.when(F.count_if(running & F.col(value).isNull()) == 0, F.coalesce(F.sum(value), F.lit(0.0)))


def mix_shares(df: DataFrame, keys: Keys, total: str, parts: Sequence[str]) -> DataFrame:
    """Each part's share of the total by key; 0 without a total."""
    sums = df.groupBy(*keys).agg(F.sum(total).alias("_total"), *[F.sum(F.coalesce(F.col(p), F.lit(0.0))).alias(f"_{p}") for p in parts])
    return sums.select(*keys, *[F.coalesce(safe_div(f"_{p}", "_total"), F.lit(0.0)).alias(f"{p}_share") for p in parts])


def seasonal_profiles(df: DataFrame, keys: Keys, levels: Keys, value: str) -> DataFrame:
    """Means by all levels, by all but the last, and so on to the keys alone, in one pass; depth tells the number of levels."""
    sets = [list(keys) + list(levels[:n]) for n in range(len(levels), -1, -1)]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, *levels]])
    depth = len(levels) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return grouped.agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("samples"), depth.alias("depth"))


def column_profile(df: DataFrame, columns: Keys) -> DataFrame:
    """For each column rows, non-null, null, zero and negative counts, min, max, mean and deviation, in one pass over df."""
    stats = {
        "non_null": lambda c: F.count(c), "zeros": lambda c: F.count_if(F.col(c) == 0), "negatives": lambda c: F.count_if(F.col(c) < 0),
        "least": lambda c: F.min(c).cast("double"), "most": lambda c: F.max(c).cast("double"), "mean": lambda c: F.avg(c).cast("double"), "deviation": lambda c: F.stddev_samp(c).cast("double"),
    }
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{c}__{s}") for c in columns for s, f in stats.items()])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in columns])
    out = one.select("rows", F.explode(each).alias("x")).select("x.column_name", "rows", *[f"x.{s}" for s in stats])
    return out.withColumn("nulls", F.col("rows") - F.col("non_null")).withColumn("non_null_pct", F.col("non_null") * 100.0 / F.col("rows"))


def overview(df: DataFrame, distinct: Keys, ranges: Keys) -> DataFrame:
    """One row: rows, distinct counts, first and last of time columns."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct], *[f(c).alias(f"{n}_{c}") for c in ranges for n, f in (("first", F.min), ("last", F.max))])


def coverage_counts(df: DataFrame, keys: Keys, distinct: Keys, value: str) -> DataFrame:
    """By key: rows, distinct counts, rows with a value and with a positive one."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct], F.count(value).alias("non_null_rows"), F.count_if(F.col(value) > 0).alias("positive_rows"))


def duplicate_keys(df: DataFrame, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def frequencies(df: DataFrame, columns: Keys) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def summary(df: DataFrame, keys: Keys, sums: Keys = (), means: Keys = ()) -> DataFrame:
    """By key: rows, totals and means."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"total_{c}") for c in sums], *[F.avg(c).alias(f"mean_{c}") for c in means])


#: Precision of a sketch: 2^12 registers, 1.04 / 64 = 1.6 % standard error, at most 2 KB.
SKETCH_BITS, SKETCH_ERROR = 12, 1.04 / 2**6


def distinct_sketches(df: DataFrame, by: Keys, columns: Keys, bits: int = SKETCH_BITS) -> DataFrame:
    """By key (a partition): rows, and a mergeable sketch of each column's distinct values. Stored once for each partition, they answer
    for any set of partitions without reading rows again."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(f"sketch_{c}") for c in columns])


def distinct_estimates(sketches: DataFrame, columns: Keys, by: Keys = ()) -> DataFrame:
    """Rows and estimated distinct counts of the sketches' union, by key or over all."""
    united = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")), F.lit(0)).alias(f"distinct_{c}") for c in columns]
    return sketches.groupBy(*by).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *united)


def grown_sketches(stored: DataFrame, df: DataFrame, by: Keys, columns: Keys) -> DataFrame:
    """The stored sketches and those of the partitions of df that they lack; partitions that are there are not read."""
    new = df.join(F.broadcast(stored.select(*by).distinct()), list(by), "left_anti")  # partitions, not rows
    return stored.unionByName(distinct_sketches(new, by, columns))
