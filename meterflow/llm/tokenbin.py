"""Token ids in bit-packed binary files, and reading them back.

A file holds the documents of one range of ids, in ascending order. Ids are packed with the least bits that the
vocabulary needs, in blocks of BLOCK ids that start on a byte; block and document offsets follow the ids, so that numpy unpacks any
block by itself. Layout: the blocks; int64 document ids; int64 first id of each document, and one past the last; int64 byte offset of each
block, and one past the last; then TAIL (magic, bits, block size, documents, how many of them, at the end, have no id, ids, blocks).

A writing task names its file after its partition and attempt and reports the name in its row. The manifest
holds the rows of the tasks that Spark has accepted, so files of lost or repeated attempts are never read.

Cases: NULL text is the empty text (only its end id). NULL ids come last and back as NULL; rows of equal ids are written one after
another in the order of their texts' hashes, so a repeated task writes the same file, and such rows can be split over files. Other
columns are ignored; an empty table gives a manifest without documents.

Files are written by the workers through pyarrow, which knows file, hdfs, s3, gs and abfs; Hadoop's names of the same stores are translated.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.llm import wordtok
from meterflow.llm.common import partitions, scratch, texts_of

BLOCK = 4096
MAGIC = b"TOKBITS2"
TAIL = struct.Struct("<8sIIqqqq")
#: Hadoop's names of stores, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs", "webhdfs": "hdfs"}
_MANIFEST = "shard int, file string, n_docs long, n_ids long"


def bits_for(vocab_size: int) -> int:
    """Bits that hold every id below vocab_size."""
    return max(1, (vocab_size - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """ids, bits each, most significant bit first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()


def unpacked(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits).astype(np.uint32)
    return (each << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


def pyarrow_uri(path: str) -> str:
    """The path as pyarrow names it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return f"file://{path}"
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(pyarrow_uri(path))


class Writer:
    """Writes one file, a block at a time."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.rest, self.docs, self.unnamed, self.starts, self.blocks = np.zeros(0, "<u4"), [], 0, [0], [0]

    def add(self, doc_ids: list[int | None], ids: list[bytes]) -> None:
        """Documents (those without an id last) and their ids as little-endian unsigned 32-bit integers."""
        self.docs += [0 if x is None else x for x in doc_ids]
        self.unnamed += sum(x is None for x in doc_ids)
        for x in ids:
            self.starts.append(self.starts[-1] + len(x) // 4)
        new = np.concatenate([self.rest, np.frombuffer(b"".join(ids), "<u4")])
        whole = len(new) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(new[i : i + BLOCK])
        self.rest = new[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        raw = packed(ids, self.bits)
        self.sink.write(raw)
        self.blocks.append(self.blocks[-1] + len(raw))

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        for x in (self.docs, self.starts, self.blocks):
            self.sink.write(np.array(x, "<i8").tobytes())
        self.sink.write(TAIL.pack(MAGIC, self.bits, BLOCK, len(self.docs), self.unnamed, self.starts[-1], len(self.blocks) - 1))


class Reader:
    """Random access to the documents of a file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        magic, self.bits, self.block, docs, unnamed, self.n_ids, blocks = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        n = (docs + docs + 1 + blocks + 1) * 8
        index = np.frombuffer(source.read_at(n, size - TAIL.size - n), "<i8")
        self.doc_ids, self.starts, self.blocks = index[:docs], index[docs : 2 * docs + 1], index[2 * docs + 1 :]
        self.no_id = np.arange(docs) >= docs - unnamed

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file; only their blocks are read."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        raw = self.source.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        here, out = int(self.blocks[first]), []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpacked(raw[int(self.blocks[b]) - here : int(self.blocks[b + 1]) - here], self.bits, n))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, at_once: int = 1 << 20):
        """(documents' positions, their ids joined) for groups of documents with about so many ids."""
        k = 0
        while k < len(self.doc_ids):
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + at_once, "right")) - 1)
            yield range(k, end), self.ids(int(self.starts[k]), int(self.starts[end]))
            k = end


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> str:
    """Write the files and their manifest below path; the manifest's path is returned."""
    spark = df.sparkSession
    filesystem, folder = _filesystem(path)
    filesystem.create_dir(folder, recursive=True)

    def run(batches):
        shard, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        where, root = _filesystem(path)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        with where.open_output_stream(f"{root}/{name}") as sink:
            writer = Writer(sink, bits_for(wordtok.vocab_size(tokenizer)))
            for part, ids in wordtok.encoded(batches, tokenizer):
                writer.add(part.column("doc_id").to_pylist(), [x + end for x in ids])
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.starts[-1]], pa.int64())], ["shard", "file", "n_docs", "n_ids"])

    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    ordered = texts_of(df, id_col, text_col).repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(run, _MANIFEST).write.parquet(f"{path}/manifest")
    return f"{path}/manifest"


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files below path; start counts over all files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).filter("n_docs > 0")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        where, root = _filesystem(path)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with where.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source)
                    for docs, ids in reader.documents():
                        raw, at = memoryview(ids.tobytes()), (reader.starts[docs.start : docs.stop + 1] - reader.starts[docs.start]).tolist()
                        each = [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])]
                        columns = [pa.array(reader.doc_ids[docs.start : docs.stop], mask=reader.no_id[docs.start : docs.stop]), pa.array(reader.starts[docs.start : docs.stop] + first), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in each], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names)

    dealt = files.select("shard", "file", "before").repartitionByRange(partitions(spark), "shard")
    return dealt.mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write df's documents to the shared folder and read them back."""
    path = scratch(df.sparkSession, "tokens")
    write(df, path, tokenizer, end_id, id_col, text_col)
    return read(df.sparkSession, path)


__all__ = ["Reader", "Writer", "bits_for", "packed", "read", "round_trip", "unpacked", "write"]
