"""Join operators. Dimensions are deduplicated before they meet facts, so no join multiplies rows by accident."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(facts: DataFrame, dimension: DataFrame, fact_key: str, dim_key: str, keep: Sequence[str]) -> DataFrame:
    """Facts with the dimension's columns, or NULLs; of several rows of a code the least one counts.

    Whether the dimension is broadcast is left to Spark, which knows its size.
    """
    one = dimension.groupBy(dim_key).agg(F.min(F.struct(*keep)).alias("_dim")).select(F.col(dim_key).alias(fact_key), "_dim.*")
    return facts.join(one, fact_key, "left")


def unmatched(facts: DataFrame, dimension: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Distinct keys of facts that the dimension lacks."""
    return facts.select(fact_key).distinct().join(dimension.select(F.col(dim_key).alias(fact_key)), fact_key, "left_anti")


def affected(df: DataFrame, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has been touched."""
    return df.join(touched.select(*keys).distinct(), list(keys), "left_semi")


def with_next_hour(touched: DataFrame, hour: str, back: int = 0, ahead: int = 1) -> DataFrame:
    """Touched keys with the hours before (which deltas need) and after (whose deltas change)."""
    moves = F.sequence(F.lit(-back), F.lit(ahead))
    rest = [c for c in touched.columns if c != hour]
    return touched.select(*rest, F.explode(F.transform(moves, lambda n: F.col(hour) + F.make_dt_interval(F.lit(0), n))).alias(hour)).distinct()


def fill_from_header(units: DataFrame, header: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A unit's value, or where that is NULL the one of the header of its keys."""
    one = header.groupBy(*keys).agg(F.max(value).alias("_header"))
    return units.join(one, list(keys), "left").withColumn(value, F.coalesce(value, "_header")).drop("_header")


def assemble(tables: Sequence[DataFrame], keys: Sequence[str], how: str = "full") -> DataFrame:
    """All tables side by side on their keys."""
    return reduce(lambda a, b: a.join(b, list(keys), how), tables)


def cascade(df: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str], str]], name: str, default: float = 0.0) -> DataFrame:
    """The first value that is known, from tables of growing coarseness: (table, keys, its value)."""
    found = []
    for i, (table, keys, value) in enumerate(levels):
        df = df.join(table.select(*keys, F.col(value).alias(f"_level{i}")), list(keys), "left")
        found.append(F.col(f"_level{i}"))
    return df.withColumn(name, F.coalesce(*found, F.lit(default))).drop(*[f"_level{i}" for i in range(len(levels))])


def at_offset(df: DataFrame, other: DataFrame, keys: Sequence[str], ts: str, value: str, hours: Sequence[int], prefix: str = "at_") -> DataFrame:
    """For each row the other table's value exactly so many hours before, or NULL; of several values of that time the greatest.

    One pass: both tables lie in one window by key and time, with a frame of a single instant for each offset.
    """
    known = other.select(*keys, ts, F.col(value).alias("_value"))
    rows = df.withColumn("_asks", F.lit(True)).unionByName(known, allowMissingColumns=True).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    instant = Window.partitionBy(*keys).orderBy("_at")
    hour = 3_600_000_000
    return rows.withColumns({f"{prefix}{h}": F.max("_value").over(instant.rangeBetween(-h * hour, -h * hour)) for h in hours}).filter("_asks").drop("_asks", "_value", "_at")


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str], labels: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """Keys that only one side has, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    one = lambda x, y, label: x.join(y, list(keys), "left_anti").withColumn("side", F.lit(label))
    return one(a, b, labels[0]).unionByName(one(b, a, labels[1]))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], values: dict[str, str], tolerance: float = 1e-4) -> DataFrame:
    """Counts of matching keys, of keys on one side, and of pairs of values (left: right) that differ by more than the tolerance."""
    a = left.select(*keys, *[F.col(x).alias(f"_l_{x}") for x in values], F.lit(True).alias("_in_left"))
    b = right.select(*keys, *[F.col(y).alias(f"_r_{x}") for x, y in values.items()], F.lit(True).alias("_in_right"))
    both = F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull()
    off = {x: F.count_if(both & (F.abs(F.col(f"_l_{x}") - F.col(f"_r_{x}")) > tolerance)).alias(f"{x}_mismatch") for x in values}
    return a.join(b, list(keys), "full").agg(F.count_if(both).alias("matched"), F.count_if(F.col("_in_right").isNull()).alias("left_only"), F.count_if(F.col("_in_left").isNull()).alias("right_only"), *off.values())


def replicate(df: DataFrame, times: int, key: str) -> DataFrame:
    """Each row so many times, its key numbered: simulated stations for scale tests."""
    return df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(key, F.concat_ws("_", F.col(key), F.col("replica"))).drop("replica")


def text_filter(df: DataFrame, columns: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Rows of which any column contains any word, in any case."""
    text = F.lower(F.concat_ws(" ", *columns))
    found: Column = reduce(lambda a, b: a | b, [text.contains(w.lower()) for w in words])
    return df.filter(found)
