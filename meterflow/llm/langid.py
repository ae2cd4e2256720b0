"""Languages of texts: each document is a mixture of languages, and expectation-maximisation finds its shares.

A text is read as overlapping triples of letters (in lower case, marks kept, everything else one boundary), hashed to ``BUCKETS`` cells. Learning
counts the triples of each language over all documents that may teach; its result is a table of languages by cells, which is all that
reaches the driver and the workers. For each document EM estimates the languages' shares from the triples' likelihoods. The set of
languages is then chosen by penalised likelihood: the best single language, or the two, three, ... of greatest share, each set refitted, as long as
the gain in log-likelihood is worth more than half the logarithm of the number of letters for each language added (overlapping
triples tell a letter three times, so the likelihood is divided by three). The prediction is the language of greatest share in the set.

Learning sums counts in the workers: a task emits one row for each language and cell, so a hot language or source is no hot key. The
number of languages bounds the model; beyond ``MOST_LANGUAGES`` distinct values learning is refused rather than cut.

Held out (crc32 of the id as text, mod 4, is 2) and rows without an id never teach, nor do rows of NULL text or language. Cases: texts that are NULL or
have no letter are ``und`` with score 0, as are all texts if nothing was learned; a NULL id is not held out; repeated rows count
each; equal likelihoods go to the least language name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import slices, texts_of, worker_tools
from meterflow.llm.shingles import mixed

BUCKETS, TRIPLE, MOST_LANGUAGES = 1 << 16, 3, 200
#: Weight of the background in a language's distribution, steps of EM over all languages and over a chosen set.
SMOOTH, STEPS, SET_STEPS = 2000.0, 12, 6
UNKNOWN = "und"
#: Cells of the likelihood table of a slice: characters times languages.
CELLS = 6_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, itself if it is a mark, 0 otherwise."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        kind = unicodedata.category(c := chr(i))[0]
        if kind == "L":
            lower = c.lower()
            out[i] = ord(lower) if len(lower) == 1 else i
        elif kind == "M":
            out[i] = i
    return out


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell) of each letter of all texts, with its neighbours."""
    table = worker_tools(("letters",), _letters)
    joined = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [1, *[len(t) + 1 for t in texts]]) - 1
    letters = table[joined]
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0  # of several boundaries in a row one stays
    keep[0] = True
    letters, owner = letters[keep].astype(np.uint64), owner[keep]
    centre = np.flatnonzero(letters)
    cell = mixed(letters[centre - 1] * _A + letters[centre] * _B + letters[centre + 1] * _C) & np.uint64(BUCKETS - 1)
    return owner[centre], cell.astype(np.int64)


@dataclass
class Model:
    """Languages in order, and for each cell the likelihood under each of them."""

    languages: list[str]
    cells: np.ndarray

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(shares of the chosen languages of each text, score of the greatest): all 0 without letters."""
        shares, score = np.zeros((len(texts), len(self.languages)), np.float32), np.zeros(len(texts))
        owner, cell = triples(texts)
        if not len(owner) or not self.languages:
            return shares, score
        keys, weight = np.unique(owner * BUCKETS + cell, return_counts=True)
        docs, first = np.unique(keys // BUCKETS, return_index=True)
        fit = _Fit(self.cells[keys % BUCKETS], weight.astype(np.float32), first)
        shares[docs], score[docs] = fit.chosen()
        return shares, score


class _Fit:
    """Mixtures of some texts, whose cells follow one another: likelihoods by cell and language, occurrences, each text's first cell."""

    def __init__(self, likely: np.ndarray, weight: np.ndarray, first: np.ndarray):
        self.likely, self.weight, self.first = likely, weight, first
        self.sizes = np.diff(np.append(first, len(weight)))
        self.letters = np.add.reduceat(weight, first)

    def steps(self, shares: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares after n steps of expectation-maximisation, and the log-likelihood before the last; a share of 0 stays."""
        for _ in range(n):
            joint = np.repeat(shares, self.sizes, 0) * self.likely
            total = joint.sum(1)
            joint *= (self.weight / total)[:, None]
            shares = np.add.reduceat(joint, self.first) / self.letters[:, None]
        return shares, np.add.reduceat(self.weight * np.log(total), self.first)

    def part(self, texts: np.ndarray) -> _Fit:
        rows = np.repeat(self.first[texts], self.sizes[texts])
        sizes = self.sizes[texts]
        rows = rows + np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return _Fit(self.likely[rows], self.weight[rows], np.cumsum(sizes) - sizes)

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(self.first), self.likely.shape[1]
        single = np.stack([np.add.reduceat(self.weight * np.log(self.likely[:, j]), self.first) for j in range(k)], 1) / TRIPLE
        best = single.argmax(1)
        value = single[np.arange(n), best]
        score = 1 / np.exp(single - value[:, None]).sum(1)
        shares = np.zeros((n, k), np.float32)
        shares[np.arange(n), best] = 1
        if k == 1:
            return shares, score
        full, _ = self.steps(np.full((n, k), 1 / k, np.float32), STEPS)
        order = np.argsort(-full, 1, kind="stable")
        open_, price = np.arange(n), np.log(self.letters + 1) / 2
        for size in range(2, k + 1):
            fit = self.part(open_)
            start = np.zeros((len(open_), k), np.float32)
            np.put_along_axis(start, order[open_, :size], np.take_along_axis(full[open_], order[open_, :size], 1) + 1e-3, 1)
            refit, log_likelihood = fit.steps(start / start.sum(1, keepdims=True), SET_STEPS)
            gained = log_likelihood / TRIPLE - value[open_] > price[open_]
            open_, refit = open_[gained], refit[gained]
            if not len(open_):
                break
            value[open_] = log_likelihood[gained] / TRIPLE
            shares[open_], score[open_] = refit, refit.max(1)
        return shares, score


def held_out(id_col: str | Column = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from all documents that may teach."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang").dictionary_encode()
                owner, cell = triples(part.column("text").to_pylist())
                found = np.bincount(langs.indices.to_numpy(zero_copy_only=False)[owner] * BUCKETS + cell, minlength=len(langs.dictionary) * BUCKETS)
                for lang, counts in zip(langs.dictionary.to_pylist(), found.reshape(-1, BUCKETS)):
                    sums[lang] = sums[lang] + counts if lang in sums else counts
        for lang, counts in sums.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full), pa.array(counts[full])], ["lang", "cell", "n"])

    counts = texts_of(rows, extra=("lang",)).mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most MOST_LANGUAGES x BUCKETS rows
    coded = found.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    seen = coded.dictionary.to_pylist()
    names = sorted(seen)
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages: the model is made for at most {MOST_LANGUAGES}")
    table = np.zeros((len(names), BUCKETS))
    place = np.array([names.index(x) for x in seen], np.int64)
    table[place[coded.indices.to_numpy(zero_copy_only=False)], found.column("cell").to_numpy()] = found.column("n").to_numpy()
    ground = (table.sum(0) + 1) / (table.sum() + BUCKETS)
    return Model(names, np.ascontiguousarray(((table + SMOOTH * ground) / (table.sum(1, keepdims=True) + SMOOTH)).T.astype(np.float32)))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every row; languages: the chosen ones with their shares, greatest first."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # languages x cells, bounded by MOST_LANGUAGES

    def run(batches):
        model = sent.value
        for batch in batches:
            for part in slices(batch, max(100_000, CELLS // max(1, len(model.languages)))):
                shares, score = model.mixtures(part.column("text").to_pylist())
                order = np.argsort(-shares, 1, kind="stable")
                size = (shares > 0).sum(1)
                names = pa.array([*model.languages, UNKNOWN], pa.string())
                best = order[:, 0] if len(model.languages) else np.zeros(len(score), np.int64)
                picked = order[np.arange(order.shape[1]) < size[:, None]]
                rows = np.repeat(np.arange(len(score)), size)
                sets = pa.StructArray.from_arrays([names.take(pa.array(picked)), pa.array(shares[rows, picked].astype(float))], ["lang", "share"])
                offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), names.take(pa.array(np.where(size > 0, best, len(model.languages)))), pa.array(score.clip(0, 1)), pa.ListArray.from_arrays(offsets, sets)],
                    ["doc_id", "lang_pred", "score", "languages"],
                )

    rows = texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
