"""MinHash near-duplicate detection with tensored banding.

A text's set: its distinct five-word shingles. Two collections of M groups of HALF minhash values each give M * M table keys, one
for every pair of a group of the first and a group of the second collection: 2 * M * HALF minhash values serve tables
that would need M * M * 2 * HALF. At similarity s two texts share a table with probability (1 - (1 - s**HALF)**M)**2; M follows from
the least similarity (10 for 0.75), so that a link of just that similarity shares one with 0.9995. Every link is confirmed on the full sets.

Equal sets are one class (grouped by a 128-bit digest). In a table's bucket each class is compared with the bucket's smallest
one, the head, and linked classes are merged. Where many classes of a head's buckets stay outside its component, a few of them are
further heads, compared with all those of other components, and so on in rounds, so that a large group of edited copies grows
together without meeting pair by pair. Only classes that still share a bucket with another component meet that component's members
there, within the join's condition: a pair goes on if its sizes allow a link, its distances from the common
head differ by no more than a link's distance (Jaccard distance is a metric), and enough minhash values agree. It
goes on once, from the first table that its texts share. Pairs within a component are never made. Of VALUES minhash values,
kept to four bits each, a pair must share as many as a link of the least similarity has but for LOST of all cases. In a bucket
with more than CROWDED classes the pairs that the estimate lets through would grow with the square of a group whose texts resemble
each other without being linked; there it rests on FINER further values, one bit each, made for the classes of such buckets alone.
Tables that are needed no longer are deleted on the way.

Cases: texts without words have an empty set, size 0, and link with nothing. NULL ids take no part: size as usual, no
component, kept. Rows with equal ids: all their sets count for the id. Other columns are ignored by ``near_duplicates`` and
kept by ``without_near_duplicates``, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import uuid
from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import as_rows, dropped, shared_dir, slices, stored, texts_of, worker_tools
from meterflow.llm.components import components
from meterflow.llm.shingles import WORDS, Shingler, minhashes, mixed, permutations

#: Minhash values in each group.
HALF = 2
SEED = 7
#: Odd multipliers that turn a group into one number.
GROUP_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Least similarity in hundredths.
LEAST = 75
#: Minhash values of a class (those beyond the tables' only sharpen the estimate), and the share of links that each of the two estimates may miss.
VALUES, LOST = 256, 2.6e-4
#: Heads with more classes outside their component get further heads beside them, so many in a round, for so many rounds at most.
FEW_OUTSIDE, HEADS, ROUNDS = 16, 4, 4
#: Buckets with more classes than CROWDED, when all heads have been compared, have their pairs estimated from FINER values.
CROWDED, FINER = 16, 2048
#: Pairs whose ids are sent to every task (a few megabytes) instead of shuffling the texts.
FEW_PAIRS = 100_000


def groups_for(least: int) -> int:
    """Groups in each collection: a pair of the least similarity shares one of a collection's but for LOST of all cases."""
    return max(1, min(ceil(log(LOST) / log(1 - min(least, 99) ** HALF / 100**HALF)), VALUES // (2 * HALF)))


def least_equal(least: float, values: int = VALUES, lost: float = LOST) -> int:
    """How many of so many minhash values two sets of the least similarity (a share) agree in, but for a share of lost."""
    total, hit, miss = 0.0, log(least), log(max(1 - least, 1e-300))
    for k in range(values + 1):
        total += exp(lgamma(values + 1) - lgamma(k + 1) - lgamma(values - k + 1) + k * hit + (values - k) * miss)
        if total > lost:
            return k
    return values


def _tools() -> tuple[Shingler, tuple]:
    return worker_tools(("near",), lambda: (Shingler(WORDS), permutations(VALUES, SEED)))


def _sketches(texts: DataFrame, m: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, minhash values) of (doc_id, text)."""

    def run(batches):
        shingler, (a, b) = _tools()
        for batch in batches:
            for part in slices(batch, 1_000_000):
                hashes, counts = shingler.hashes(part.column("text"))
                values = minhashes(hashes, counts, a, b)
                digests = set_digests(hashes, counts)
                groups = mixed(values[:, : 2 * m * HALF].reshape(-1, 2 * m, HALF).astype(np.uint64) @ GROUP_MIX).astype(np.uint32).view(np.int32)
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists(groups), lists(nibbles(values))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "groups", "marks"])

    return texts.mapInArrow(run, "doc_id long, n_shingles long, digest binary, groups array<int>, marks array<long>")


def set_digests(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each sorted set; the sets lie one after another."""
    raw, ends = memoryview(hashes.tobytes()), (np.cumsum(counts) * 8).tolist()
    return [hashlib.blake2b(raw[e - 8 * n : e], digest_size=16).digest() for e, n in zip(ends, counts.tolist())]


def lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def nibbles(values: np.ndarray) -> np.ndarray:
    """The low four bits of each value, sixteen to a 64-bit integer."""
    low = (values & np.uint32(15)).astype(np.uint64).reshape(len(values), -1, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def _finer(texts: DataFrame) -> DataFrame:
    """(doc, finer) of (doc, text): the lowest bit of each of FINER further minhash values, 64 to an integer."""

    def run(batches):
        shingler, (a, b) = worker_tools(("finer",), lambda: (Shingler(WORDS), permutations(FINER, SEED + 1)))
        for batch in batches:
            for part in slices(batch, 1_000_000):
                values = minhashes(*shingler.hashes(part.column("text")), a, b)
                yield pa.RecordBatch.from_arrays([part.column("doc"), lists(bits(values))], ["doc", "finer"])

    return texts.mapInArrow(run, "doc long, finer array<long>")


def bits(values: np.ndarray) -> np.ndarray:
    """The lowest bit of each value, 64 to a 64-bit integer."""
    return np.packbits((values & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64)


def _table_rows(classes: DataFrame, m: int) -> DataFrame:
    """(table, key, doc): m * m rows for each class."""
    first, second = F.slice("groups", 1, m), F.slice("groups", m + 1, m)
    pair = lambda x, i, y, j: F.struct((i * m + j).alias("table"), F.xxhash64(i * m + j, x, y).alias("key"))
    keys = F.flatten(F.transform(first, lambda x, i: F.transform(second, lambda y, j: pair(x, i, y, j))))
    return classes.select("doc", F.explode(keys).alias("k")).select("k.table", "k.key", "doc")


def _first_table(m: int) -> Column:
    """The first table that u and v share: that of their first equal groups."""
    equal = lambda start: F.array_position(F.zip_with(F.slice("groups_u", start, m), F.slice("groups_v", start, m), lambda a, b: a == b), True) - 1
    return equal(1) * m + equal(m + 1)


def _sets(texts: DataFrame) -> DataFrame:
    """(doc, shingles): the set of each (doc, text), as hashes."""

    def run(batches):
        shingler, _ = _tools()
        for batch in batches:
            for part in slices(batch, 1_000_000):
                hashes, counts = shingler.hashes(part.column("text"))
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64)))], ["doc", "shingles"])

    return texts.mapInArrow(run, "doc long, shingles array<long>")


def _compared(pairs: DataFrame, held: DataFrame, work: str) -> DataFrame:
    """(u, v, both, either) of pairs: sizes of intersection and union of the full sets, made for the texts that the pairs have."""
    now = f"{work}/now"
    pairs = stored(pairs, f"{now}/pairs")
    docs = pairs.select(F.col("u").alias("doc")).distinct().unionByName(pairs.select(F.col("v").alias("doc")).distinct()).distinct()
    docs = F.broadcast(docs) if pairs.count() <= FEW_PAIRS else docs
    sets = stored(_sets(held.join(docs, "doc", "left_semi")), f"{now}/sets")
    side = lambda s: sets.select(F.col("doc").alias(s), F.col("shingles").alias(f"set_{s}"))
    both = F.size(F.array_intersect("set_u", "set_v")).cast("long")
    met = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", both.alias("both"), (F.size("set_u") + F.size("set_v")).alias("total"))
    done = stored(met.select("u", "v", "both", (F.col("total") - F.col("both")).alias("either")), "compared")
    dropped(pairs.sparkSession, f"{shared_dir(pairs.sparkSession)}/{now}")
    return done


def _sizes_allow(least: int) -> Column:
    return 100 * F.least("n_shingles_u", "n_shingles_v") >= least * F.greatest("n_shingles_u", "n_shingles_v")


def _marks_allow(least: int, values: int) -> Column:
    """Whether enough of the minhash values of u and v, four bits each, are equal for a link."""
    equal = F.lit(values)
    for i in range(values // 16):  # a nibble that differs leaves one of its bits
        x = F.get("marks_u", F.lit(i)).bitwiseXOR(F.get("marks_v", F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        equal = equal - F.bit_count(x)
    return equal >= least_equal(least / 100, values)


def _finer_allow(least: int) -> Column:
    """The same for FINER values of one bit, which are equal by chance in half of the other cases."""
    equal = F.lit(FINER)
    for i in range(FINER // 64):
        equal = equal - F.bit_count(F.get("finer_u", F.lit(i)).bitwiseXOR(F.get("finer_v", F.lit(i))))
    return equal >= least_equal((1 + least / 100) / 2, FINER)


def _side(df: DataFrame, s: str) -> DataFrame:
    """df as one side of pairs: doc becomes s, every other column gets its name as suffix."""
    return df.withColumnsRenamed({c: s if c == "doc" else f"{c}_{s}" for c in df.columns})


def linked(classes: DataFrame, rows: DataFrame, texts: DataFrame, least: int, values: int, first_table: Column) -> tuple[DataFrame, DataFrame]:
    """Links (u, v, both, either) and (node, root) for every class that has a link.

    classes: stored (doc, n_shingles, marks and what first_table needs); rows: (table, key, doc); texts: (doc, text) with a text of
    each class at least. Two classes that share a bucket and reach the least similarity are in one component at the end.
    """
    spark, work = classes.sparkSession, f"near-{uuid.uuid4().hex}"
    buckets = rows.groupBy("table", "key").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = stored(rows.join(buckets, ["table", "key"]), f"{work}/shared")
    held = stored(texts.join(shared.select("doc").distinct(), "doc", "left_semi"), f"{work}/texts")
    sides, may = classes.select("doc", "n_shingles", "marks"), _sizes_allow(least) & _marks_allow(least, values)
    reached = 100 * F.col("both") >= least * F.col("either")

    # A head's group: all classes that share a bucket with it where it is the smallest, each once however many buckets they share.
    groups = stored(shared.filter("doc <> head").select("head", "doc").distinct().join(sides, "doc"), f"{work}/groups")
    members = _side(groups, "v")
    pairs = members.join(_side(sides, "u"), (F.col("head_v") == F.col("u")) & may).select("u", "v")
    stars = _compared(pairs, held, work)
    links = stars.filter(reached)
    roots = components(links.select("u", "v"))
    for turn in range(ROUNDS):
        root = lambda of, name: roots.select(F.col("node").alias(of), F.col("root").alias(name))  # noqa: B023, E731
        at = members.join(root("v", "root"), "v", "left").join(root("head_v", "top"), "head_v", "left")
        at = stored(at.withColumns({"root_v": F.coalesce("root", "v"), "top": F.coalesce("top", "head_v")}).drop("root"), f"{work}/placed")
        chosen = [F.min(F.struct(F.xxhash64("v", F.lit(turn * HEADS + i)).alias("h"), F.col("v").alias("u"), F.col("root_v").alias("root_u"))) for i in range(HEADS)]
        outside = at.filter("root_v <> top").groupBy("head_v").agg(F.count(F.lit(1)).alias("n"), F.array(*chosen).alias("further")).filter(F.col("n") > FEW_OUTSIDE)
        heads = outside.select(F.col("head_v").alias("of"), F.explode("further").alias("h")).select("of", "h.u", "h.root_u").dropDuplicates(["of", "root_u"])
        heads = stored(heads.join(_side(sides, "u"), "u"), f"{work}/heads")
        if heads.isEmpty():
            break
        pairs = at.join(heads, (F.col("head_v") == F.col("of")) & (F.col("root_v") != F.col("root_u")) & may).select("u", "v").distinct()
        new = _compared(pairs, held, work).filter(reached)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        roots = components(links.select("u", "v"))

    # Buckets with more than one component, each class with its distance from the bucket's head where it has been compared.
    at = shared.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    several = at.groupBy("table", "key").agg(F.min("root").alias("least"), F.max("root").alias("most"), (F.count(F.lit(1)) > CROWDED).alias("crowded"))
    inside = stored(at.join(several.filter("least < most").drop("least", "most"), ["table", "key"]), f"{work}/inside")
    finer = stored(_finer(held.join(inside.filter("crowded").select("doc").distinct(), "doc", "left_semi")), f"{work}/finer")
    distances = stars.select(F.col("u").alias("head"), F.col("v").alias("doc"), (1 - F.col("both") / F.col("either")).alias("far"))
    inside = inside.join(distances, ["head", "doc"], "left").withColumn("far", F.when(F.col("doc") == F.col("head"), 0.0).otherwise(F.col("far"))).drop("head")
    # A class is estimated by one of the two kinds of values, as its bucket is crowded or not.
    estimates = {"marks": F.when(~F.col("crowded"), F.col("marks")), "finer": F.when(F.col("crowded"), F.col("finer"))}
    inside = inside.join(classes, "doc").join(finer, "doc", "left").withColumns(estimates)
    alike = F.when(F.col("crowded_u"), _finer_allow(least)).otherwise(_marks_allow(least, values))
    near_head = F.coalesce(F.abs(F.col("far_u") - F.col("far_v")) <= 1 - least / 100 + 1e-9, F.lit(True))
    apart = (F.col("table_u") == F.col("table_v")) & (F.col("key_u") == F.col("key_v")) & (F.col("root_u") < F.col("root_v"))
    pairs = _side(inside, "u").join(_side(inside, "v"), apart & near_head & _sizes_allow(least) & (first_table == F.col("table_u")) & alike)
    new = _compared(pairs.select("u", "v"), held, work).filter(reached)
    if not new.isEmpty():
        links = links.unionByName(new)
        roots = components(links.select("u", "v"))
    dropped(spark, f"{shared_dir(spark)}/{work}")
    return links, roots


def near_duplicates(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    texts, m = texts_of(df, id_col, text_col), groups_for(least)
    sketches = stored(_sketches(texts, m), "sketches")
    real = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Classes of equal sets, by their smallest id.
    classes = real.groupBy("digest").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("n_shingles", "groups", "marks")])
    classes = stored(classes, "classes")
    _, roots = linked(classes.drop("digest"), _table_rows(classes, m), texts.withColumnRenamed("doc_id", "doc"), least, VALUES, _first_table(m))
    by_class = classes.select("digest", F.col("doc").alias("node")).join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay: of each component the smallest id."""
    found = near_duplicates(df, least, id_col, text_col)
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("key")).distinct()
    return as_rows(df, F.col(id_col).cast("long").alias("key")).join(gone, "key", "left_anti").select("row.*")
