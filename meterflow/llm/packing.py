"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Each document is tokenised in the worker that reads it and ends with an end id; longer documents are cut into
capacity-long pieces. Only piece sizes move: they are dealt evenly over as many tasks as their number asks for, and
each task packs its pieces by bounded-space best fit: a fixed number of open bins, a bitset with
a bit for each free space of which a bin is open (the best fit is the lowest set bit at or above the length), and
when all bins are open the fullest one closes. Pieces come in lots of as many as bins may be open, in the order of a hash,
and within a lot largest first: every lot is a sample of all lengths, so large pieces never close the bins that small ones
would fill, whatever number of pieces a task has. The result depends on the rows alone, so a lost task packs the same again.

Cases: NULL text is the empty text (one piece: its end id). Rows with equal ids are packed each on its own and NULL ids
come back as NULL. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm import wordtok
from meterflow.llm.common import partitions, stored, texts_of

CAPACITY = 2048
#: Bins open at a time in a task.
OPEN_BINS = 8192
#: Pieces that are worth a task of their own, and that a task takes at most when there are many tasks.
FEW_PIECES, MANY_PIECES = 20_000, 1_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Open bins, found by their free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.count = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            which, free, self.made = self.made, self.capacity, self.made + 1
        left = free - length
        if left:  # a full bin closes
            self.by_free[left].append(which)
            self.bits |= 1 << left
            self.count += 1
        return which, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        which = bins.pop()
        self.count -= 1
        if not bins:
            self.bits ^= 1 << free
        return which


def pack_sizes(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order of arrival."""
    bins = BestFit(capacity, open_bins)
    return [bins.place(n) for n in lengths]


def lots(batches: Iterable[pa.RecordBatch], size: int) -> Iterable[pa.RecordBatch]:
    """The rows of the batches in their order, so many to a batch, however they have come."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size).combine_chunks().to_batches()[0]
            held, rows = table.slice(size).to_batches(), rows - size
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""

    def run(batches):
        end = np.array([end_id], "<u4").tobytes()
        for part, ids in wordtok.encoded(batches, path):
            rows = [(d, k, k * capacity, x) for d, raw in zip(part.column("doc_id").to_pylist(), ids) for k, x in enumerate(cut(raw + end, capacity * 4))]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[3]) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r[3]) for r in rows], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[3], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts_of(df, id_col, text_col).mapInArrow(run, _PIECES + ", ids array<int>" * with_ids)


def cut(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and a length of 1 to capacity."""
    spark = pieces.sparkSession
    total = pieces.count()
    tasks = max(1, min(-(-total // FEW_PIECES), max(partitions(spark), -(-total // MANY_PIECES))))

    def run(batches):
        bins, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in lots(batches, open_bins):
            batch = batch.take(pa.array(np.argsort(-batch.column("length").to_numpy(), kind="stable")))
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    known = [c for c, t in pieces.dtypes if not t.startswith("array")]
    dealt = pieces.repartition(tasks).sortWithinPartitions(F.xxhash64(*known), *known)
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's pieces and their places. The sizes are stored once, as their number decides how many tasks pack."""
    made = pieces(df, path, capacity, end_id, id_col, text_col, with_ids)
    return pack(stored(made, "pieces"), capacity, open_bins)
