"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside Spark partitions.

``encode`` splits each text by the pattern and turns the distinct new pieces of a few megabytes of text into
token-position rows. A recursive query joins neighbouring rows with the merge table and contracts each piece's leftmost
pair of minimum rank until no pair is left. ``decode`` joins id rows with the vocabulary and concatenates the bytes by
ordered aggregation. Workers keep recent pieces, so a frequent word is computed once; nothing is shuffled.

Cases: NULL text is the empty text, which has no ids and decodes to no bytes. Rows with equal or NULL ids stay
separate rows. Other columns are ignored, whatever their names; an empty table gives an empty table. Pieces
over LONG bytes are merged with a heap, as the recursion takes a step for every merge of the longest piece.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import warnings
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import RecentRows, distinct, slices, strings, texts_of, worker_tools

LONG = 400
#: Pieces, words and decoded runs that a worker keeps.
RECENT = 400_000
#: Bytes of text that are encoded at a time, and pieces or runs in a query.
SLICE, QUERY = 6_000_000, 50_000
#: Bits for a position within a piece.
POSITION = 9
#: White space other than the space and the line feed.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Token-position rows; place = word * 512 + position. A pair's number orders by rank, then position; the right one of
#: the two rows that a word contracts goes.
ENCODE = """
WITH RECURSIVE tok AS (
  SELECT place, id, lead(id) OVER win AS next_id, lead(place) OVER win AS next_place, false AS done
  FROM (SELECT r.place, b.id FROM new_bytes r JOIN single_bytes b ON b.byte = r.byte) WINDOW win AS (ORDER BY place)
  UNION ALL
  (WITH pairs AS (SELECT t.place, t.next_place, t.place >> 9 AS word, t.id, m.rank * 512 + (t.place & 511) AS pair
                  FROM tok t LEFT JOIN merges m
                    ON m.left_right = CASE WHEN t.next_place >> 9 = t.place >> 9 THEN t.id::UINTEGER * 65536::UINTEGER + t.next_id::UINTEGER END
                  WHERE NOT t.done),
        best AS (SELECT word, min(pair) AS pair, arg_min(next_place, pair) AS gone FROM pairs GROUP BY word),
        kept AS (SELECT p.place, CASE WHEN p.pair = b.pair THEN b.pair >> 9 ELSE p.id END AS id, b.pair IS NULL AS done
                 FROM pairs p JOIN best b ON p.word = b.word
                 WHERE b.pair IS NULL OR p.place <> b.gone)
   SELECT place, id, lead(id) OVER win, lead(place) OVER win, done
   FROM kept WINDOW win AS (ORDER BY place)))
SELECT place >> 9 AS word, id FROM tok WHERE done ORDER BY place"""

#: Id rows of runs in groups: the runs of a group one after another.
DECODE = """
SELECT run_group, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM new_ids JOIN vocabulary USING (id) GROUP BY run_group ORDER BY run_group"""
GROUP = 512


class Codec:
    """One worker's tables and caches for a rank file and its pattern."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        top = max(self.ranks.values()) + 1
        if top > 65536:
            raise ValueError("pairs of ids are numbered in 32 bits: at most 65,536 tokens")
        self.pattern = regex.compile(pattern)
        self.words, self.pieces, self.runs = RecentRows(RECENT), RecentRows(RECENT), RecentRows(RECENT, "u1")
        warnings.filterwarnings("ignore", message="Arrow output on a DB-API")
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(x << 16 | y, r) for token, r in self.ranks.items() for x, y in self._halves(token)]
        for name, columns in {
            "merges": {"left_right": pa.array([p for p, _ in pairs], pa.uint32()), "rank": pa.array([r for _, r in pairs], pa.int32())},
            "single_bytes": {"byte": pa.array(range(256), pa.uint8()), "id": pa.array([self.ranks[bytes([i])] for i in range(256)], pa.int32())},
            "vocabulary": {"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": pa.array([x.hex() for x in self.ranks], pa.string())},
        }.items():
            self.db.register("given", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.opens, self.sizes = np.zeros(top, bool), np.zeros(top, np.int64)  # tokens at which a run begins, and all tokens' sizes
        self.opens[[i for token, i in self.ranks.items() if token[:1] == b" "]] = True
        self.sizes[list(self.ranks.values())] = list(map(len, self.ranks))

    def _halves(self, token: bytes):
        """The ids of every two tokens that make the token."""
        for i in range(1, len(token)):
            x, y = self.ranks.get(token[:i]), self.ranks.get(token[i:])
            if x is not None and y is not None:
                yield x, y

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows)
        out = self.db.execute(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def _piece_ids(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(pieces, their ids one after another, how many each has): tokens as they are, long ones by the heap, all others by the query."""
        raw = [x.encode() for x in pieces]
        known = [(p, self.ranks[x]) for p, x in zip(pieces, raw) if x in self.ranks]
        rest = [(p, x) for p, x in zip(pieces, raw) if x not in self.ranks]
        long, rest = [(p, self.merged(x)) for p, x in rest if len(x) > LONG], [(p, x) for p, x in rest if len(x) <= LONG]
        ids = [np.array([i for _, i in known], "<u4"), *(np.array(x, "<u4") for _, x in long)]
        sizes = [np.ones(len(known), np.int64), np.array([len(x) for _, x in long], np.int64)]
        for i in range(0, len(rest), QUERY):
            part = [x for _, x in rest[i : i + QUERY]]
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            words = np.repeat(np.arange(len(part)), lengths)
            at = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            rows = {"place": ((words << POSITION) + at).astype(np.int32), "byte": np.frombuffer(b"".join(part), np.uint8)}
            out = self._query("new_bytes", pa.table(rows), ENCODE)
            ids.append(out.column("id").to_numpy().astype("<u4"))
            sizes.append(np.bincount(out.column("word").to_numpy(), minlength=len(part)))
        return [p for p, _ in known + long + rest], np.concatenate(ids), np.concatenate(sizes)

    def merged(self, raw: bytes) -> list[int]:
        """The ids of one long piece: a heap of pairs over a linked list."""
        ids, n = [self.ranks[raw[i : i + 1]] for i in range(len(raw))], len(raw)
        start, after, before, ends = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [i + 1 for i in range(n)]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := self.ranks.get(raw[start[i] : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[i], ends[j]))

        for i in range(n):
            offer(i)
        alive = [True] * n
        while heap:
            r, i, mid, end = heapq.heappop(heap)
            if not alive[i] or ends[i] != mid or (j := after[i]) >= n or ends[j] != end:
                continue
            ids[i], ends[i], alive[j], after[i] = r, end, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for x, a in zip(ids, alive) if a]

    def _joined(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every list of pieces, and where each list's begin (and the last one's end)."""
        codes, pieces = distinct(pa.array(list(chain.from_iterable(lists)), pa.string()))
        flat, at = self.pieces.gathered(self.pieces.rows(strings(pieces), self._piece_ids)[codes])
        return flat, at[np.concatenate([[0], np.cumsum(list(map(len, lists)), dtype=np.int64)])]

    def _word_ids(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The ids of words with a space before them."""
        find = self.pattern.findall
        flat, at = self._joined([find(" " + w) for w in words])
        return words, flat, np.diff(at)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A word may be taken with the one space before it if no other white space touches that space; such texts
        are split by Arrow, which also finds the distinct words. The others are split by the pattern as a whole.
        """
        plain, heads = [], []
        for i, text in enumerate(texts.to_pylist()):
            if "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
                heads.append(self.pattern.findall(text))
            else:
                plain.append(i)
                heads.append(self.pattern.findall(text.partition(" ")[0]))
        first, at = self._joined(heads)
        raw, ends = first.tobytes(), (at * 4).tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        split = pc.split_pattern(texts.take(pa.array(plain, pa.int64())), " ")
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        flat = split.flatten()
        tail = np.ones(len(flat), bool)
        tail[(np.cumsum(sizes) - sizes).astype(np.int64)] = False  # the first word has no space before it
        codes, words = distinct(flat.filter(pa.array(tail)))
        ids, at = self.words.gathered(self.words.rows(strings(words), self._word_ids)[codes])
        raw, ends = ids.tobytes(), (at[np.concatenate([[0], np.cumsum(sizes - 1)]).astype(np.int64)] * 4).tolist()
        for i, a, b in zip(plain, ends, ends[1:]):
            out[i] += raw[a:b]
        return out

    def _run_bytes(self, runs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The bytes behind runs of ids."""
        made, sizes = [], []
        for i in range(0, len(runs), QUERY):
            part = runs[i : i + QUERY]
            ids, lengths = np.frombuffer(b"".join(part), "<u4").astype(np.int32), np.fromiter(map(len, part), np.int64, len(part)) // 4
            group = (np.repeat(np.arange(len(part)), lengths) // GROUP).astype(np.int32)
            out = self._query("new_ids", pa.table({"run_group": group, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}), DECODE)
            made += out.column("bytes").to_pylist()
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(lengths)])]
            sizes.append(np.diff(ends))
        return runs, np.frombuffer(b"".join(made), "u1"), np.concatenate(sizes)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes behind each list of ids: distinct runs of ids that begin with a space are looked up or queried."""
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        starts = np.cumsum(sizes) - sizes
        begins = self.opens[flat]
        begins[starts[sizes > 0]] = True
        at = np.flatnonzero(begins)
        offsets = np.append(at, len(flat)).astype(np.int32) * 4
        codes, runs = distinct(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.tobytes())]))
        made, ends = self.runs.gathered(self.runs.rows(strings(runs), self._run_bytes)[codes])
        raw, docs = made.tobytes(), ends[np.searchsorted(at, np.append(starts, len(flat)))].tolist()
        return [raw[a:b] for a, b in zip(docs, docs[1:])]


def codec(path: str, pattern: str) -> Codec:
    return worker_tools(("bytes", path, pattern), lambda: Codec(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for each row."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, SLICE):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>").select(F.col("doc_id").alias(id_col), "ids")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary) for each row of ids; NULL ids are no ids."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            raw = c.decode([np.array(x or [], "<u4").tobytes() for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, bytes binary").select(F.col("doc_id").alias(id_col), "bytes")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest each text in one pass, so that ids never leave the worker."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, SLICE):
                ids = c.encode(part.column("text"))
                hexed = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), hexed(ids), hexed(c.decode(ids))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
