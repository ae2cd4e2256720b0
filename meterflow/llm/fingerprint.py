"""MinHash document fingerprints.

A fingerprint holds, for PERMUTATIONS universal hash functions over a text's distinct five-word shingles (vectorised
numpy), 16 bits of the least hash value, written in hexadecimal. The likeness of two fingerprints is the share of equal
values, an unbiased estimate of the shingle sets' Jaccard similarity up to collisions of 2^-16. ``near_duplicates`` joins
bands of the signatures in Spark, verifies the similarity of the shingle sets themselves and gives every text its component.

``compare`` also edits each text: its last half is replaced by the first characters of the next document in descending
order of id (after the last: the first). For that, documents are dealt by ranges of ids, one to a task, and sorted; the one
neighbour beyond each range is dealt to it too.

Cases: NULL text is the empty text: no shingles, a fingerprint of its own, likeness 1 to other empty texts. Equal ids are
ordered by a hash of their text; NULL ids come first in descending order. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import partitions, slices, stored, texts_of, worker_tools
from meterflow.llm.neardup import LEAST, linked, lists, nibbles, set_digests
from meterflow.llm.shingles import Shingler, minhashes, permutations

PERMUTATIONS = 128
SEED = 11


def _tools(n: int) -> tuple[Shingler, tuple]:
    return worker_tools(("fingerprints", n), lambda: (Shingler(), permutations(n, SEED)))


def signatures(texts: list[str], n: int = PERMUTATIONS) -> np.ndarray:
    """16-bit values, a row for each text."""
    shingler, (a, b) = _tools(n)
    return (minhashes(*shingler.hashes(texts), a, b) & np.uint32(0xFFFF)).astype(">u2")


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(1) if len(x) else np.zeros(0)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1_000_000):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([x.tobytes().hex() for x in signatures(texts)])], ["doc_id", "n_chars", "fingerprint"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string").select(F.col("doc_id").alias(id_col), "n_chars", "fingerprint")


def _sketches(texts: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, fingerprint, minhash values kept to four bits) of (doc_id, text)."""

    def run(batches):
        shingler, (a, b) = _tools(PERMUTATIONS)
        for batch in batches:
            for part in slices(batch, 1_000_000):
                hashes, counts = shingler.hashes(part.column("text"))
                values = minhashes(hashes, counts, a, b) & np.uint32(0xFFFF)
                fingerprints = pa.array([x.tobytes().hex() for x in values.astype(">u2")], pa.string())
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(set_digests(hashes, counts), pa.binary()), fingerprints, lists(nibbles(values))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "fingerprint", "marks"])

    return texts.mapInArrow(run, "doc_id long, n_shingles long, digest binary, fingerprint string, marks array<long>")


def near_duplicates(df: DataFrame, least: int = LEAST, bands: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links (a, b, intersection, union) and members (id, class_id, component_id).

    A class is the texts of one shingle set, by its smallest id. The signature's bands are the tables of ``neardup.linked``, which
    verifies candidates on the full sets, so two classes that share a band and reach the least similarity (in hundredths) are
    in one component, linked to each other or through others; only pairs that are in one component already are not compared.
    NULL ids take no part in classes and links; such a row gets the class of its set, if a row with an id has made one. bands: as many as a link of the least similarity needs, if not given.
    """
    bands = bands or bands_for(least)
    texts = texts_of(df, id_col, text_col)
    sketches = stored(_sketches(texts), "sketches")
    real = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    width = PERMUTATIONS * 4 // bands
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring("fingerprint", i * width + 1, F.lit(width)))
    classes = real.groupBy("digest").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("n_shingles", "fingerprint", "marks")])
    classes = stored(classes.withColumn("keys", keys).drop("fingerprint"), "classes")
    rows = classes.select("doc", F.posexplode("keys").alias("table", "key"))
    first_band = F.array_position(F.zip_with("keys_u", "keys_v", lambda x, y: x == y), True) - 1
    links, roots = linked(classes.drop("digest"), rows, texts.withColumnRenamed("doc_id", "doc"), least, PERMUTATIONS, first_band)
    by_class = classes.select("digest", "doc").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("digest", "doc", F.coalesce("root", "doc").alias("root"))
    members = sketches.select("doc_id", "digest", "n_shingles").join(by_class, "digest", "left")
    own = lambda c: F.when(F.col("n_shingles") > 0, F.col(c)).otherwise(F.col("doc_id"))
    named = links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.col("both").alias("intersection"), F.col("either").alias("union")).distinct()
    return named, members.select(F.col("doc_id").alias(id_col), own("doc").alias("class_id"), own("root").alias("component_id"))


def bands_for(least: int, lost: float = 1e-4) -> int:
    """The fewest bands (a power of two) of which a pair of the least similarity shares one, but for a share of lost."""
    bands = 1
    while bands < PERMUTATIONS and (1 - (least / 100) ** (PERMUTATIONS // bands)) ** bands > lost:
        bands *= 2
    return bands


def near_pairs(df: DataFrame, least: int = LEAST, bands: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The links of ``near_duplicates``: (a, b, intersection, union)."""
    return near_duplicates(df, least, bands, id_col, text_col)[0]


#: Rows of the sample from which the bounds of a range are told.
SAMPLED = 200


def _with_neighbours(texts: DataFrame, tasks: int) -> DataFrame:
    """(part, own, none, doc_id, mark, text): each document in its range of the order, and for each range the document after its last.

    The order: NULL ids first, then falling ids, rows of equal ids by a hash of their text. The ranges' bounds come from a sample
    (SAMPLED rows a range) like those of any range partitioning; only they, and each range's first row without its text, visit the driver.
    """
    spark = texts.sparkSession
    keyed = texts.select(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("mark"), "text")
    place = F.struct("none", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "mark")
    n = keyed.count()
    if not n:
        return keyed.select(F.lit(0).alias("part"), F.lit(True).alias("own"), *keyed.columns)
    sample = sorted(tuple(r["p"]) for r in keyed.sample(min(1.0, SAMPLED * tasks / n), seed=SEED).select(place.alias("p")).collect())
    bounds = sorted({sample[len(sample) * i // tasks] for i in range(1, tasks)}) if sample else []
    literal = lambda b: F.struct(F.lit(b[0]).alias("none"), F.lit(b[1]).cast("long").alias("doc_id"), F.lit(b[2]).cast("long").alias("mark"))
    part = F.array_size(F.filter(F.array(*map(literal, bounds)), lambda b: b < place)) if bounds else F.lit(0)
    own = keyed.select(part.alias("part"), F.lit(True).alias("own"), *keyed.columns)
    # The first row of each range that has rows, to follow the last one of the next higher such range; the first of all follows the last.
    tops = [(r["part"], *r["top"]) for r in own.groupBy("part").agg(F.max(place).alias("top")).orderBy("part").collect()]
    goes = [(tops[(i + 1) % len(tops)][0], *top[1:]) for i, top in enumerate(tops)]
    moves = F.broadcast(spark.createDataFrame(goes, "to int, to_none boolean, to_id long, to_mark long"))  # a row for each range
    same = (F.col("none") == F.col("to_none")) & (F.coalesce("doc_id", F.lit(0)) == F.col("to_id")) & (F.col("mark") == F.col("to_mark"))
    beyond = keyed.join(moves, same).groupBy("to").agg(*[F.first(c).alias(c) for c in keyed.columns])
    return own.unionByName(beyond.select(F.col("to").alias("part"), F.lit(False).alias("own"), *keyed.columns))


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness to each other and to the next document's."""
    spark = df.sparkSession
    tasks = partitions(spark)
    dealt = _with_neighbours(texts_of(df, id_col, text_col), tasks)

    def run(batches):
        last, held = None, None  # the part and text that wait for their following text

        def out(rows):
            ids, texts, follow = ([r[i] for r in rows] for i in range(3))
            changed = [edited(t, f) for t, f in zip(texts, follow)]
            n, marks = len(rows), signatures(texts + changed + follow[-1:])
            own, new, following = marks[:n], marks[n : 2 * n], np.concatenate([marks[1:n], marks[2 * n :]])
            wanted = [i for i in range(n - 1) if follow[i] is not texts[i + 1]]  # at the end of a range
            if wanted:
                following[wanted] = signatures([follow[i] for i in wanted])
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in changed]
            columns = [pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(digest), pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in new]), pa.array(likeness(own, new)), pa.array(likeness(own, following))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ready, size = [], 0
        for batch in batches:
            for part, own, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "doc_id", "text"))):
                if held is not None and part == last:
                    ready.append((*held, text))
                    size += len(held[1])
                held, last = (doc, text) if own else None, part
                if size > 500_000:
                    yield out(ready)
                    ready, size = [], 0
        if ready:
            yield out(ready)

    # A range is a task, in descending order; the neighbour from the range below (for the lowest range: the highest) comes after all own rows.
    ordered = dealt.repartitionById(tasks, F.col("part")).sortWithinPartitions(*map(F.desc, ("own", "none", "doc_id", "mark", "text")))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema)
