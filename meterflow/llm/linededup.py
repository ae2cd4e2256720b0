"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches of ascending id. A run is a table of line hashes, bucketed and sorted by hash, with the document that
owns each. A batch's hashes (one row for each, with its smallest document) are merge-anti-joined with every run, bucket by
bucket without moving or sorting the runs; what is left is owned by the batch and becomes a run of level 0. When a level has FANOUT
runs they are merged into one run of the next level, bucket by bucket without moving them (the write sorts a bucket's rows, as it does for
every run), so a batch meets few runs however many came before. At the end every document gets the hashes it owns and keeps just those lines, whose number is bounded by the document's own lines: a line
that a third of all documents share is owned by one of them. Runs in a folder of their own outlive the call: a batch of another
day is deduplicated against them, and adds its own; of earlier runs it reads hashes, and the owners only where they are
within the day's ids, so that the archive is not moved and the files' statistics skip what is older.

A line's key: the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Keys shorter than MIN_CHARS code
points always stay. A key's hash has 128 bits.

Cases: NULL or empty text is one empty line. A document is an id and a text (by a 64-bit hash): rows alike in both count as
one, rows of one id with other texts are documents of their own in the order of that hash, and so are rows of NULL id, which
come last. Extra columns are ignored by ``dedup_lines`` and kept by ``dedup_texts``, whatever their names. Empty tables give
empty tables.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.common import as_rows, dropped, listed, partitions, scratch, slices, worker_tools

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
_HASH = struct.Struct("<qq")
RUN_COLUMNS = ["hi", "lo", "doc", "part"]


def line_hash(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The hash of a line's key; None if the key is too short to count."""
    key = line.strip(SPACE)
    return hashlib.md5(key.encode().lower()).digest() if len(key) >= min_chars else None


def halves(h: bytes) -> tuple[int, int]:
    return _HASH.unpack(h)


class Runs:
    """Runs of line hashes by level, as bucketed tables in a folder; each run's name tells its level and number of buckets.

    While runs are read, Spark's settings keep the order of bucketed scans (a run has one file a bucket, so that its order holds) and
    read by bucket also where only a union follows.
    """

    NAME = re.compile(r"run_([0-9]+)_([0-9]+)_[0-9a-f]{32}$")
    READING = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    #: A union of columnar scans would lay the runs' partitions one after another instead of bucket by bucket (Spark 4.1).
    BY_ROW = {"spark.sql.parquet.enableVectorizedReader": "false"}

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.path = path or scratch(spark, "runs")
        for name in listed(spark, self.path):
            if m := self.NAME.search(name):
                self._register(name, int(m[2]))
                self._of(int(m[1])).append(name)

    def _of(self, level: int) -> list[str]:
        while level >= len(self.levels):
            self.levels.append([])
        return self.levels[level]

    def _register(self, name: str, buckets: int) -> None:
        columns = ", ".join(f"{c} BIGINT" for c in RUN_COLUMNS)
        layout = f"USING parquet CLUSTERED BY (hi, lo) SORTED BY (hi, lo) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'"
        self.spark.sql(f"CREATE TABLE {name} ({columns}) {layout}")

    @contextmanager
    def reading(self, by_row: bool = False):
        """The session's settings while runs are read; by_row for a union of runs."""
        wanted = {**self.READING, **(self.BY_ROW if by_row else {})}
        before = {name: self.spark.conf.get(name) for name in wanted}
        try:
            for name, value in wanted.items():
                self.spark.conf.set(name, value)
            yield
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)

    def add(self, lines: DataFrame) -> None:
        """Anti-join a batch of (hi, lo, doc, part) with the runs and add what it owns as a new run."""
        first = F.struct(F.col("doc").isNull().alias("none"), "doc", "part")  # NULL ids come last
        with self.reading():
            own = lines.groupBy("hi", "lo").agg(F.min(first).alias("owner"))
            for run in self.tables():
                own = own.join(self.spark.table(run).select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
            buckets = partitions(self.spark)
            self._put(0, own.select("hi", "lo", "owner.doc", "owner.part").repartition(buckets, "hi", "lo"), buckets)

    def _put(self, level: int, rows: DataFrame, buckets: int) -> None:
        name = f"run_{level}_{buckets}_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, "hi", "lo").sortBy("hi", "lo").option("path", f"{self.path}/{name}").saveAsTable(name)
        if sum(x.startswith("part-") for x in listed(self.spark, f"{self.path}/{name}")) > buckets:
            raise RuntimeError(f"{name}: a bucket has several files, so that it is not in order")
        at = self._of(level)
        at.append(name)
        if len(at) >= self.fanout:
            old, self.levels[level] = at, []
            with self.reading(by_row=True):
                self._put(level + 1, self._merged(old), max(int(self.NAME.search(x)[2]) for x in old))
            for x in old:
                self._drop(x)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs of disjoint hashes as one. A bucket's rows of all runs meet in one task: the union keeps the runs' partitioning if they have
        equally many buckets, and then nothing is left to repartition. To be planned and run in ``reading(by_row=True)``."""
        rows = reduce(DataFrame.unionAll, (self.spark.table(x).select(*RUN_COLUMNS) for x in names))
        return rows.repartition(max(int(self.NAME.search(x)[2]) for x in names), "hi", "lo")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        dropped(self.spark, f"{self.path}/{name}")

    def tables(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def close(self, owners: Column | None = None) -> DataFrame:
        """Take the tables out of the catalog; their files stay. Gives the rows (hi, lo, doc, part), those of some owners or all."""
        files = [f"{self.path}/{x}" for x in self.tables()]
        for x in self.tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")
        schema = ", ".join(f"{c} long" for c in RUN_COLUMNS)
        rows = self.spark.read.schema(schema).parquet(*files)
        return rows if owners is None else rows.filter(owners)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc, part) for each distinct key of each row of (doc, part, text)."""

    def run(batches):
        worker_tools(("lines",), lambda: None)
        for batch in batches:
            for piece in slices(batch, 4_000_000):
                docs, parts, his, los = [], [], [], []
                for d, k, text in zip(*(piece.column(c).to_pylist() for c in ("doc", "part", "text"))):
                    for h in {h for x in text.split("\n") if (h := line_hash(x, min_chars))}:
                        hi, lo = halves(h)
                        docs.append(d), parts.append(k), his.append(hi), los.append(lo)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (his, los, docs, parts)], RUN_COLUMNS)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in RUN_COLUMNS))


def _owned(docs: DataFrame, batches: int, min_chars: int, folder: str | None) -> DataFrame:
    """(doc, part, owned array<struct<hi, lo>>) of (doc, part, text)."""
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    known = docs.select("doc").agg(F.percentile_approx("doc", shares, 10_000).alias("bounds"), F.min("doc").alias("least"), F.max("doc").alias("most")).first()
    bounds = known["bounds"] or []
    staged, batch = scratch(spark, "lines"), F.lit(0)
    for b in sorted(set(bounds)):
        batch = batch + F.coalesce((F.col("doc") > b).cast("int"), F.lit(1))
    lines = hashed_lines(docs, min_chars).withColumn("batch", batch)
    lines.write.partitionBy("batch").parquet(staged)
    read = spark.read.schema(", ".join(f"{c} long" for c in RUN_COLUMNS) + ", batch int").parquet(staged)
    runs = Runs(spark, folder)
    for b in range(len(set(bounds)) + 1):
        runs.add(read.filter(F.col("batch") == b).select(*RUN_COLUMNS))
    dropped(spark, staged)
    mine = F.col("doc").isNull()
    if known["least"] is not None:
        mine = mine | F.col("doc").between(known["least"], known["most"])
    return runs.close(mine).groupBy("doc", "part").agg(F.collect_list(F.struct("hi", "lo")).alias("owned"))


def _kept(text: str, owned: set, min_chars: int) -> tuple[int, int, str]:
    lines = text.split("\n")
    stay = [x for x in lines if (h := line_hash(x, min_chars)) is None or h in owned]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


def _owned_sets(column: pa.Array):
    """The set of hashes of each row."""
    flat = column.flatten()
    hashes = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo")], 1).astype("<i8").tobytes()
    each, at = [hashes[i : i + _HASH.size] for i in range(0, len(hashes), _HASH.size)], 0
    for n in pc.list_value_length(column).to_pylist():
        yield set(each[at : at + (n or 0)])
        at += n or 0


def _document(text_col: str, id_col: str) -> list[Column]:
    """The document of a row: its id and a hash of its text; and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("part"), text.alias("text")]


def _kept_texts(rows: DataFrame, carried: list[str], batches: int, min_chars: int, folder: str | None) -> DataFrame:
    """carried columns, n_lines, n_dropped and the lines that stay, of (doc, part, text and carried)."""
    owned = _owned(rows.select("doc", "part", "text"), batches, min_chars, folder)
    mine = owned.withColumnsRenamed({"doc": "doc_2", "part": "part_2"})
    joined = rows.join(mine, F.col("doc").eqNullSafe(F.col("doc_2")) & (F.col("part") == F.col("part_2")), "left").select(*carried, "text", "owned")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 4_000_000):
                done = [_kept(t, o, min_chars) for t, o in zip(piece.column("text").to_pylist(), _owned_sets(piece.column("owned")))]
                columns = [pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carried), *columns], [*carried, "n_lines", "n_dropped", "text"])

    schema = rows.select(*carried).schema.add("n_lines", "long").add("n_dropped", "long").add("text", "string")
    return joined.mapInArrow(run, schema)


def dedup_lines(df: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row. folder: where runs of earlier calls are and this call's stay."""
    rows = df.select(*_document(text_col, id_col))
    return _kept_texts(rows, ["doc"], batches, min_chars, folder).withColumnRenamed("doc", "doc_id")


def dedup_texts(df: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """df with each text replaced by its lines that stay; a NULL text stays NULL."""
    rows = as_rows(df, *_document(text_col, id_col))
    made = _kept_texts(rows, ["row"], batches, min_chars, folder)
    clean = F.when(F.col("row").getField(text_col).isNotNull(), F.col("text"))
    return made.select(*[clean.alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in df.columns])
