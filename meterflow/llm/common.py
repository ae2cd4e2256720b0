"""What the corpus operators share: tables, the shared scratch folder, id keys and worker-side caches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent (tests, one machine) a folder of this machine is set instead; on a cluster
    that would lose data, so it is refused there.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if known:
        if current.isEmpty():
            sc.setCheckpointDir(known)
        return known
    if not current.isEmpty():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: later jobs start from the files."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a scratch path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(x.getPath().getName() for x in files.listStatus(p)) if files.exists(p) else []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch at most: whole texts are large, and a batch is held by the JVM and by the worker at once.
BATCH_ROWS = 2000


def _small_batches(df: DataFrame) -> None:
    """Arrow batches of few rows for the session, unless it has smaller ones."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple = ()) -> DataFrame:
    """Only the id and the text (NULL: empty), so that other columns and their names don't matter."""
    _small_batches(df)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)


def as_rows(df: DataFrame, *columns: Column) -> DataFrame:
    """The columns given, and every row of df as one struct named row, so that no column of df meets a name of an operator."""
    _small_batches(df)
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *columns)


def slices(batch: pa.RecordBatch, chars: int = 2_000_000, column: str = "text"):
    """Parts of a batch with about so many bytes of text; a single longer text is a part of its own."""
    sizes = batch.column(column).value_lengths() if hasattr(batch.column(column), "value_lengths") else None
    lengths = (pc.binary_length(batch.column(column)) if sizes is None else sizes).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + (n or 0) > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def distinct(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct values) of an Arrow array."""
    coded = values.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def strings(values: pa.Array) -> list[str]:
    """What to_pylist gives for strings without NULLs, faster."""
    return values.to_numpy(zero_copy_only=False).tolist()


_TOOLS: dict = {}


def worker_tools(key: tuple, make):
    """What a worker keeps from task to task. It keeps one such thing at a time: workers live on from stage to stage, and what an
    earlier stage has kept must not add to what this one needs."""
    if key not in _TOOLS:
        _TOOLS.clear()
        _give_back()
        _TOOLS[key] = make()
    return _TOOLS[key]


def _give_back() -> None:
    """Return freed memory to the system: by itself an allocator keeps it for the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class RecentRows:
    """A bounded cache of keys' integer sequences, which lie one after another in one array.

    When it would get fuller than most, only the keys of the call at hand stay.
    """

    def __init__(self, most: int, dtype: str = "<u4"):
        self.most, self.at, self.flat, self.starts = most, {}, np.zeros(0, dtype), np.zeros(1, np.int64)

    def rows(self, keys: list, learn) -> np.ndarray:
        """The row of each of the distinct keys. learn(new keys) gives (keys in any order, their values joined, sizes)."""
        found = list(map(self.at.get, keys))
        new = [k for k, row in zip(keys, found) if row is None]
        if new:
            if len(self.at) + len(new) > self.most:
                known = [k for k, row in zip(keys, found) if row is not None]
                self.flat, self.starts = self.gathered(np.array([row for row in found if row is not None], np.int64))
                self.at = dict(zip(known, range(len(known))))
            learned, flat, sizes = learn(new)
            self.at.update(zip(learned, range(len(self.at), len(self.at) + len(learned))))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat])
            found = list(map(self.at.__getitem__, keys))
        return np.array(found, np.int64)

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' values one after another, and where each row's begin (and the last one's end)."""
        first = self.starts[rows]
        sizes = self.starts[rows + 1] - first
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        index = np.repeat(first - ends[:-1], sizes)
        index += np.arange(len(index))
        return self.flat[index], ends
