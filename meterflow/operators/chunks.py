"""Windows on long series, cut into chunks of time.

A window by series puts a series' whole history into one task. Here a series is cut by month (or another unit), each chunk is solved by
itself, and what a chunk needs from others comes with it: the last n rows before it, or the last known value before and the
next one after it. What is carried is found from small tables: a row for each chunk (how many rows it has, what it ends with), passed along
the series, and the last n rows of each chunk. The results are those of the plain window; the largest task holds one chunk and n rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.operators.windows import series

Keys = Sequence[str]
CHUNK, CARRIED = "_chunk", "_carried"


def cut(df: DataFrame, ts: str, unit: str = "month") -> DataFrame:
    """Adds the start of the row's chunk."""
    return df.withColumn(CHUNK, F.date_trunc(unit, ts))


def with_rows_before(df: DataFrame, keys: Keys, order: Keys, n: int, unit: str = "month") -> DataFrame:
    """Rows with their chunk, and before each chunk's own rows (``_carried`` false) the last n rows of its series before it (true).

    A row's number in its series is that of its chunk's first row plus its number in the chunk. Among the last n rows of a chunk, row g goes to those later chunks that
    start in (g, g + n]: mostly the next one, more of them where chunks have fewer than n rows.
    """
    rows = cut(df, order[0], unit)
    sizes = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_size"))
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    ends = sizes.withColumn("_end", F.sum("_size").over(chunks.rowsBetween(Window.unboundedPreceding, 0)))
    heir = F.struct(F.col(CHUNK).alias("chunk"), (F.col("_end") - F.col("_size")).alias("start"))
    heirs = ends.select(*keys, CHUNK, "_end", F.collect_list(heir).over(chunks.rowsBetween(1, n)).alias("_heirs"))  # n chunks on, at least n rows have passed
    last = rows.withColumn("_back", F.row_number().over(series([*keys, CHUNK], order, descending=True))).filter(F.col("_back") <= n)
    needed = F.filter("_heirs", lambda h: h["start"] <= F.col("_end") - F.col("_back") + n)
    carried = last.join(heirs, [*keys, CHUNK]).withColumn(CHUNK, F.explode(F.transform(needed, lambda h: h["chunk"])))
    return rows.withColumn(CARRIED, F.lit(False)).unionByName(carried.select(*rows.columns, F.lit(True).alias(CARRIED)))


def in_chunks(df: DataFrame, keys: Keys, order: Keys, n: int, apply: Callable[[DataFrame, Keys], DataFrame], unit: str = "month") -> DataFrame:
    """What apply, a function of rows and the keys of their series that looks at most n rows back, makes of df; its windows are by chunk."""
    made = apply(with_rows_before(df, keys, order, n, unit), [*keys, CHUNK])
    return made.filter(~F.col(CARRIED)).drop(CHUNK, CARRIED)


def counter_delta(df: DataFrame, keys: Keys, bucket: str, value: str, most: float, name: str = "delta", unit: str = "month") -> DataFrame:
    """As ``windows.counter_delta``."""
    ends = df.groupBy(*keys, bucket).agg(F.max(value).alias("reading"))

    def advance(rows: DataFrame, series_keys: Keys) -> DataFrame:
        step = F.col("reading") - F.lag("reading").over(series(series_keys, [bucket]))
        return rows.withColumn(name, F.when(step.between(0, most), step))

    return in_chunks(ends, keys, [bucket], 1, advance, unit)


def clean_series(df: DataFrame, keys: Keys, order: Keys, values: Sequence[str], unit: str = "month") -> DataFrame:
    """As ``windows.clean_series``: NULLs from the last known value, else from the next one, else 0; values that aren't finite become 0."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    rows = cut(df.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c)) for c in values}), order[0], unit)
    place = F.struct(*order)
    known = lambda c: F.when(F.col(c).isNotNull(), place)
    ends = rows.groupBy(*keys, CHUNK).agg(*[f(c, known(c)).alias(f"_{n}_{c}") for c in values for n, f in (("first", F.min_by), ("last", F.max_by))])
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    before, after = chunks.rowsBetween(Window.unboundedPreceding, -1), chunks.rowsBetween(1, Window.unboundedFollowing)
    carried = {f"_before_{c}": F.last(f"_last_{c}", True).over(before) for c in values} | {f"_after_{c}": F.first(f"_first_{c}", True).over(after) for c in values}
    rows = rows.join(ends.withColumns(carried).select(*keys, CHUNK, *carried), [*keys, CHUNK])
    own = series([*keys, CHUNK], order)
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)

    def filled(c: str) -> Column:
        return F.coalesce(F.last(c, True).over(back), f"_before_{c}", F.first(c, True).over(ahead), f"_after_{c}", F.lit(0.0))

    return rows.withColumns({c: filled(c) for c in values}).drop(CHUNK, *carried)
