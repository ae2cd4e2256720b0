"""Exact token counts: a histogram of encoded lengths, and suffix sums that answer for every context limit.

Documents are counted in the worker that reads them; (length, documents) is summed map-side before it moves, so a
length that a third of all documents share is one row a task. ``suffix_sums`` adds, for each length that occurs,
the documents and tokens at or above it, and from these what a limit of that length keeps. Lengths are
grouped in ranges so that no task holds the whole histogram: sums within a range, plus the sums of the ranges above. The
histogram is stored, as both need it.

Cases: NULL text counts as empty (length 0). Ids and other columns are ignored, repeated rows count each. An empty
table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm import wordtok
from meterflow.llm.common import slices, stored, texts_of

#: Lengths in a range of the suffix sums.
RANGE = 1024


def lengths(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id key, n_tokens) of every row."""

    def run(batches):
        codec = wordtok.word_ids(path)
        for batch in batches:
            for part in slices(batch, wordtok.SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(codec.lengths(part.column("text")), pa.int64())], ["doc_id", "n_tokens"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs) for every length that occurs."""
    return lengths.groupBy(F.col(length_col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L: docs_at_least and tokens_at_least, docs_within and tokens_within (length <= L), truncated_tokens
    (sum of min(length, L)), lost_tokens (what the limit cuts off) and quantile (share of documents of length <= L)."""
    rows = stored(hist, "histogram").withColumn("bucket", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    ranges = rows.groupBy("bucket").agg(F.sum("n_docs").alias("range_docs"), F.sum("tokens").alias("range_tokens"))
    every = Window.partitionBy()
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "bucket",
        F.coalesce(F.sum("range_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("range_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("range_docs").over(every).alias("all_docs"),
        F.sum("range_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    at_least = rows.join(ranges, "bucket").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.sum("n_docs").over(within) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("tokens_above")).alias("tokens_at_least"),
    )
    docs_within = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    tokens_within = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("n_docs")
    truncated = tokens_within + (F.col("docs_at_least") - F.col("n_docs")) * F.col("n_tokens")
    return at_least.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", docs_within.alias("docs_within"), tokens_within.alias("tokens_within"),
        truncated.alias("truncated_tokens"), (F.col("all_tokens") - truncated).alias("lost_tokens"), (docs_within / F.col("all_docs")).alias("quantile"),
    )


def quantiles(sums: DataFrame, *shares: float) -> DataFrame:
    """(share, n_tokens): the least length within which at least that share of the documents lies."""
    least = [F.min(F.when(F.col("quantile") >= share, F.col("n_tokens"))).alias("n_tokens") for share in shares]
    found = sums.agg(F.array(*[F.struct(F.lit(float(share)).alias("share"), x) for share, x in zip(shares, least)]).alias("found"))
    return found.select(F.explode("found").alias("f")).select("f.share", "f.n_tokens").filter("n_tokens IS NOT NULL")


def truncated_total(sums: DataFrame, limit: int) -> Column | DataFrame:
    """(limit, kept_tokens, cut_docs) for a limit, whether or not a document has that length."""
    over = F.col("n_tokens") > limit
    return sums.agg(F.lit(limit).cast("long").alias("limit"), F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("kept_tokens"), F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("cut_docs"))
