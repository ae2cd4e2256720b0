"""Exact top-k inner-product search with MaxScore.

A vector's components become integers. A term is a dimension and a sign: its postings are the vectors whose component has that sign,
by falling weight. A query's positive contributions come from one term of each dimension, with a bound (its weight times the
largest one in the postings); everything else only lowers a score. With the k-th best score of some seed vectors as
threshold, terms whose bounds sum up to less are non-essential: a vector that no essential term has can't reach the
threshold. Essential postings are traversed, non-essential terms are probed from the largest bound down while a candidate stays
competitive, and what is left is scored exactly. A task has one shard of vectors (by id hash): its rows come first, their postings are
built once, and the queries stream past them, a batch at a time. Each shard gives at most k rows a query, and a ranking window
merges the shards.

Cases: rows with NULL id, NULL vector, or a NULL or non-finite component take no part. Shorter vectors are filled with
zeros; an empty vector scores 0. Of rows with equal ids the least vector counts. Ties go to the smaller id. Scores are exact while
they and the components fit 64 bits. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
#: Vectors in a shard on average; shards that small tables are split into.
SHARD, LEAST_SHARDS = 65_536, 32


class Shard:
    """Postings of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.terms = {}
        for d in range(vectors.shape[1]):
            column = vectors[:, d]
            for sign in (1, -1):
                weights = column * sign
                at = np.flatnonzero(weights > 0)
                if len(at):
                    at = at[np.argsort(-weights[at], kind="stable")]
                    self.terms[d, sign] = at, weights[at]

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), ties by id."""
        terms = []
        for d in np.flatnonzero(query):
            if (t := self.terms.get((int(d), 1 if query[d] > 0 else -1))) is not None:
                q = abs(int(query[d]))
                terms.append((q * int(t[1][0]), q, *t))
        terms.sort(key=lambda t: t[0])
        seeds = np.unique(np.concatenate([t[2][: 4 * k] for t in terms[-8:]])) if terms else np.zeros(0, np.int64)
        seeds = seeds[self.ids[seeds] != own]
        exact = np.sort(self.vectors[seeds] @ query)
        least = int(exact[-k]) if len(exact) >= k else 0
        if least <= 0:  # vectors without any positive contribution may be among the best
            rest = np.arange(len(self.ids))
        else:
            bounds = np.cumsum([t[0] for t in terms])
            essential = int(np.searchsorted(bounds, least))
            bound = int(bounds[essential - 1]) if essential else 0
            score = np.zeros(len(self.ids), np.int64)
            for _, q, at, weights in terms[essential:]:
                score[at] += q * weights
            rest = np.flatnonzero((score > 0) & (score + bound >= least))
            for b, q, at, weights in reversed(terms[:essential]):
                if len(rest) <= 4 * k:
                    break
                more = np.zeros(len(self.ids), np.int64)
                more[at] = q * weights
                score[rest] += more[rest]
                bound -= b
                rest = rest[score[rest] + bound >= least]
        rest = rest[self.ids[rest] != own]
        exact = self.vectors[rest] @ query
        best = np.lexsort((self.ids[rest], -exact))[:k]
        return [(int(exact[i]), int(self.ids[rest[i]])) for i in best]


def _matrix(column: pa.Array) -> np.ndarray:
    """The integer vectors of a list column, as wide as the widest."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    """rows with so many columns: zeros are added; what other vectors lack can't count and goes."""
    return np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))[:, :width]


def _shard(ids: list[np.ndarray], rows: list[np.ndarray]) -> Shard:
    """Of equal ids, which follow one another, the first counts."""
    width = max(x.shape[1] for x in rows)
    ids, rows = np.concatenate(ids), np.concatenate([_wide(x, width) for x in rows])
    first = np.append(True, ids[1:] != ids[:-1])
    return Shard(ids[first], rows[first])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of other ids with the largest inner product."""
    fit = lambda df: (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    )
    vectors, queries = fit(vectors), fit(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = vectors.count()
    shards = max(-(-n // SHARD), min(LEAST_SHARDS, -(-n // 256)), 1)
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    own = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "embedding")
    asked = queries.select(every.alias("shard"), F.lit(True).alias("asks"), "vec_id", "embedding")
    dealt = own.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("asks", "vec_id", "embedding")

    def run(batches):
        ids, rows, shard = [], [], None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(asks, True))  # the shard's own rows come first
            if split:
                part = batch.slice(0, split)
                ids.append(part.column("vec_id").to_numpy()), rows.append(_matrix(part.column("embedding")))
            if split == len(asks) or not ids:
                continue
            shard = shard or _shard(ids, rows)
            part, out = batch.slice(split), []
            for q, query in zip(part.column("vec_id").to_pylist(), _wide(_matrix(part.column("embedding")), shard.vectors.shape[1])):
                out += [(q, i, s) for s, i in shard.search(q, query, k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
