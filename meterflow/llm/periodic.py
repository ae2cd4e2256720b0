"""Runs of periodic words: every maximal stretch with its smallest period, and texts without the repeated part.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest period q (words q apart are the same) that is
at least 2 q long and that neither neighbour extends. A document is a task's own affair: no shuffle, and copies or hot
sources don't meet. Within a task documents of like length are searched together in numpy.

Method (string synchronising sets). Periods under ``DIRECT`` come from comparing the words with themselves, shifted. For every scale
tau = 2, 4, 8, ... a position is synchronising if the least hash of the tau words at it and the tau positions after it stands at the first or
the last of these; positions in highly periodic places (period up to tau / 3, known from earlier scales) don't take part. Whether a
position is chosen depends on the next 2 tau words alone, so a run of period q in [3 tau, 6 tau) has two chosen positions q apart with equal
contexts, unless one period of it is highly periodic: then it joins two neighbouring runs of one small period, which
supply q. Proposals are extended both ways by hashes of dyadic lengths (64 bits), and those of at least 2 q words are runs.

Memory: about 8 bytes a word for each power of two up to the document's length. Time: n log n for each document.

Cases: NULL, empty or blank texts have no runs and an empty collapsed text; NULL and repeated ids are rows of their own; an empty table
gives no rows; other columns of whatever names are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import slices, texts_of
from meterflow.llm.shingles import mixed

#: Periods below this are found by comparing; scales start above them.
DIRECT = 6
#: Shortest run that is reported.
LEAST = 12
#: Characters that are searched together.
SLICE = 1_500_000
_FIRST, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NEVER = np.uint64(2**64 - 1)
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _levels(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the 2^k words from each position on. Past the end nothing equals anything."""
    out, n = [mixed(words.astype(np.uint64) * _FIRST + _NEXT)], len(words)
    while 2 << (len(out) - 1) <= longest:
        step = 1 << (len(out) - 1)
        last = np.arange(n, n + min(step, n), dtype=np.uint64) * _NEXT
        ahead = np.concatenate([out[-1][step:], mixed(last ^ np.uint64(len(out)))])
        out.append(mixed(out[-1] * _FIRST + ahead))
    return out


def _extended(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from a and b on, and before them, are the same."""
    ahead, before, n = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        hashes = levels[k]
        fits = b + ahead < n
        same = hashes[a + ahead] == hashes[np.where(fits, b + ahead, 0)]
        ahead += (same & fits) * step
        at = a - before - step
        fits = at >= 0
        same = hashes[np.where(fits, at, 0)] == hashes[np.where(fits, b - before - step, 1)]
        before += (same & fits) * step
    return ahead, before


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _synchronising(hashes: np.ndarray, k: int, periodic: np.ndarray) -> np.ndarray:
    """Positions whose tau-word hash, or the one tau later, is the least of those from here to there."""
    tau = 1 << k
    hashes = np.where(periodic, _NEVER, hashes)
    least = hashes
    for j in range(k):
        least = np.minimum(least[: -(1 << j)], least[1 << j :])
    here, there = hashes[: len(hashes) - tau], hashes[tau:]
    least = np.minimum(least[: len(there)], there)
    return np.flatnonzero(((least == here) | (least == there)) & (least != _NEVER))


def _equal_contexts(at: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions of equal contexts, low <= distance < high. Contexts that repeat are not periodic, so few lie so close."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    near = np.flatnonzero(context[1:] == context[:-1])
    pairs, m = [], 1
    while True:
        near = near[near + m < len(at)]
        gap = at[near + m] - at[near]
        close = (context[near + m] == context[near]) & (gap < high)
        near, gap = near[close], gap[close]
        if not len(near):
            break
        pairs.append((at[near][gap >= low], gap[gap >= low]))
        m += 1
    return tuple(np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in range(2))


def _joined(levels: list[np.ndarray], runs: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals from neighbouring runs (start, end, period; ends excluded) of one small period: their phases give the distance."""
    runs = runs[(runs[:, 2] * 9 <= low) & (runs[:, 1] - runs[:, 0] >= low)]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    left, right = runs[:-1], runs[1:]
    meet = (left[:, 2] == right[:, 2]) & (right[:, 0] <= left[:, 1])
    left, right = left[meet], right[meet]
    none = np.zeros(0, np.int64)
    if not len(left):
        return none, none
    p = left[:, 2]
    shift = np.repeat(p, p) + _spread(p)  # p to 2 p - 1: one of them lays the right run's first period on the left run
    owner = np.repeat(np.arange(len(p)), p)
    second = np.repeat(right[:, 0], p)
    found = _extended(levels, second - shift, second)[0] >= p[owner]
    shift, owner = shift[found], owner[found]
    p, left, right = p[owner], left[owner], right[owner]
    first = shift + -(-(low - shift) // p) * p
    counts = np.maximum(0, -(-(high - first) // p))
    q = np.repeat(first, counts) + _spread(counts) * np.repeat(p, counts)
    owner = np.repeat(np.arange(len(p)), counts)
    start = np.maximum(left[owner, 0], right[owner, 0] - q)
    end = np.minimum(left[owner, 1] + q, right[owner, 1])
    whole = end - start >= 2 * q
    return start[whole], q[whole]


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period; by start."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def maximal_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of every run of a sequence of numbers, ends excluded, by start and period. Its parts end in numbers
    that occur once, so that no run crosses them; longest: the longest part."""
    found = []
    for q in range(1, min(DIRECT, len(words))):
        same = np.concatenate([[False], words[:-q] == words[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        start, end = edges[::2], edges[1::2] + q
        whole = end - start >= 2 * q
        found.append(np.stack([start[whole], end[whole], np.full(whole.sum(), q)], 1))
    runs = _least_periods(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    if 2 * DIRECT > longest:
        return _sorted(runs)
    levels, k = _levels(words, longest), 1
    while 6 << k <= longest:
        tau = 1 << k
        low, high = 3 * tau, 6 * tau
        small = runs[(runs[:, 2] <= tau // 3) & (runs[:, 1] - runs[:, 0] >= tau)]
        change = np.zeros(len(words) + 1, np.int32)
        np.add.at(change, small[:, 0], 1)
        np.add.at(change, small[:, 1] - tau + 1, -1)
        at = _synchronising(levels[k], k, np.cumsum(change[:-1]) > 0)
        pairs = [_equal_contexts(at, levels[k + 1][at], low, high), _joined(levels, runs, low, high)]
        a, q = (np.concatenate([p[i] for p in pairs]) for i in range(2))
        ahead, before = _extended(levels, a, a + q)
        whole = ahead + before >= q
        a, q, ahead, before = a[whole], q[whole], ahead[whole], before[whole]
        runs = _least_periods(np.concatenate([runs, np.stack([a - before, a + q + ahead, q], 1)]))
        k += 1
    return _sorted(runs)


def _sorted(runs: np.ndarray) -> np.ndarray:
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _searched(codes: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start, length, period of each run, by document, start and period; for each word whether it stays)."""
    starts, out, stays = np.cumsum(sizes) - sizes, [], np.ones(len(codes), bool)
    classes = np.frexp(sizes.astype(float))[1] // 2  # lengths within a factor of four
    for c in np.unique(classes[sizes >= least]):
        docs = np.flatnonzero((classes == c) & (sizes >= least))
        n = sizes[docs]
        inside = np.repeat(starts[docs], n) + _spread(n)
        begins = np.cumsum(n + 1) - n - 1
        words = np.empty(n.sum() + len(n), np.int64)
        words[begins + n] = codes.max() + 1 + np.arange(len(n))
        places = np.repeat(begins, n) + _spread(n)
        words[places] = codes[inside]
        runs = maximal_runs(words, int(n.max()))
        runs = runs[runs[:, 1] - runs[:, 0] >= least]
        owner = np.searchsorted(begins, runs[:, 0], "right") - 1
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 1], -1)
        stays[inside] = np.cumsum(change[:-1])[places] == 0
        out.append(np.stack([docs[owner], runs[:, 0] - begins[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], 1))
    found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return found[np.argsort(found[:, 0], kind="stable")], stays


def _of_texts(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of each text."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word there
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[ends])
    flat = flat.filter(pa.array(full))
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found, stays = _searched(codes, sizes, least) if len(codes) else (np.zeros((0, 4), np.int64), np.zeros(0, bool))
    struct = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(found[:, 0], minlength=len(texts)))])
    kept = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(sizes)])]
    words = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(stays)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct), pc.binary_join(words, " ")


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its runs of at least so many words, by start and period, and the text without what any run
    holds after its first period, words joined by one space."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                runs, collapsed = _of_texts(part.column("text"), least)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), runs, collapsed], ["doc_id", "runs", "collapsed"])

    return texts_of(df, id_col, text_col).mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")


def _once(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def with_planted_runs(df: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by checksum of their id, with a periodic tail.

    With h = crc32 of the decimal id and g = h div 10, where h % 10 = 0 and there are n > 0 words: word i >= a becomes word a + (i - a) % p,
    a = g % n, p = 1 + (n - a) div (3 + g % 8). A NULL id has no number: its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(w: Column, n: Column) -> Column:
        tail = F.struct((g % n).alias("a"), (F.lit(1) + F.floor((n - g % n) / (F.lit(3) + g % 8))).alias("p"))
        place = lambda x, i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int")
        return _once(tail, lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(x, i))), " "))

    made = _once(words, lambda w: _once(F.size(w).cast("long"), lambda n: F.when(n > 0, planted(w, n))))
    return df.select("doc_id", F.coalesce(F.when((h % 10 == 0) & F.col("text").isNotNull(), made), F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """What find_runs gives as one row of numbers and digests for each document; without runs start to exponent_milli are NULL."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    exponent = F.floor(1000 * length / period)  # exact: a quotient of whole numbers below 2^53
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
