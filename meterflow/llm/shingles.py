"""Word shingles as 64-bit hashes, and minhash values over them, in numpy for many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from meterflow.llm.common import RecentRows, distinct, strings

WORDS = 5
RECENT_WORDS = 300_000
#: Odd multipliers that mix the words of a shingle.
_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of texts; keeps the hashes of recent words."""

    def __init__(self, words: int = WORDS):
        self.words, self.recent = words, RecentRows(RECENT_WORDS, "<u8")

    @staticmethod
    def _hashed(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        raw = b"".join([hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words])
        return words, np.frombuffer(raw, "<u8"), np.ones(len(words), np.int64)

    def hashes(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingle hashes of all texts one after another, how many each text has).

        Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text of fewer words is one shingle, one without words has none.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        k, split = self.words, pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = split.flatten()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word there
        sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])])
        codes, words = distinct(flat.filter(pa.array(full)))
        rows = self.recent.rows(strings(words), self._hashed)
        flat = self.recent.flat[rows][codes]
        counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
        if not len(flat):
            return np.zeros(0, np.uint64), counts
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        padded = np.concatenate([flat, np.zeros(k, np.uint64)])
        total = np.zeros(len(flat), np.uint64)
        for i in range(k):  # words past a short text's end add nothing but its length
            inside = place + i < sizes[owner]
            total = mixed(total * _STEP + np.where(inside, padded[i : i + len(flat)], np.uint64(i + 1)))
        total, owner = total[starts := place < counts[owner]], owner[starts]
        ends = np.cumsum(counts)
        for start, end in zip((ends - counts).tolist(), ends.tolist()):
            total[start:end].sort()
        first = np.ones(len(total), bool)
        first[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
        return total[first], np.bincount(owner[first], minlength=len(texts))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (odd a, b) of n universal hash functions (a x + b) >> 32 of 64-bit integers."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def minhashes(hashes: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each text (row) and function (column) the least value; the greatest possible one for a text without shingles."""
    out = np.full((len(counts), len(a)), 2**32 - 1, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for j in range(len(a)):
            out[full, j] = np.minimum.reduceat(((hashes * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out
