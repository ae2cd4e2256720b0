"""Exact and fast use of a word-level BPE tokenizer file (white space dropped) inside Spark tasks.

The tokenizer's normalizer and splitter never look across a space, so a text's ids are those of its space-separated
words one after another. Each worker keeps recent words' ids; only new words go to the tokenizers library.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from meterflow.llm.common import RecentRows, distinct, slices, strings, worker_tools

#: Words and pieces whose ids a worker keeps.
RECENT_WORDS, RECENT_PIECES = 300_000, 250_000
#: Bytes of text that are encoded at a time.
SLICE = 4_000_000
#: White space other than the space and the line feed, or what some count as such.
_SPACE = regex.compile(r"[^\S\n]|[\x1c-\x1f\x85]")


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        self.vocab_size, self.end = self.tokenizer.get_vocab_size(), own["model"]["end_of_word_suffix"]
        self.special = [x["content"] for x in own["added_tokens"]]
        self.split = regex.compile(_word_pattern(own) + "| ")
        # The same model for pieces that have been normalised and split already.
        plain = own | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, own["pre_tokenizer"]["pretokenizers"][1]]}}
        self.by_piece = Tokenizer.from_str(json.dumps(plain))
        self.ends = np.zeros(self.vocab_size, bool)  # tokens that end a piece
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(self.end)]] = True
        self.words, self.pieces = RecentRows(RECENT_WORDS), RecentRows(RECENT_PIECES)

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """(ids one after another, how many each text has), text by text."""
        each = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), "<u4"), list(map(len, each))

    def _piece_ids(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        out, sizes = [], []
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            ids = np.array(self.by_piece.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(part):
                out.append(ids), sizes.append(np.diff(at, prepend=0))
            else:  # a piece that the model ends early
                ids, lengths = self._alone(part)
                out.append(ids), sizes.append(np.array(lengths, np.int64))
        return pieces, np.concatenate(out), np.concatenate(sizes)

    def _word_ids(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words without white space or special tokens share one search for their pieces; the others are encoded alone."""
        joined, odd = "\n".join(words), []
        if _SPACE.search(joined) or any(x in joined for x in self.special):
            odd = [w for w in words if _SPACE.search(w) or any(x in w for x in self.special)]
            words = list(set(words).difference(odd))
        odd += [w for w in words if not w]
        words = [w for w in words if w]
        ascii_words = [w for w in words if w.isascii()]
        others = [w for w in words if not w.isascii()]
        normal = [w.lower() for w in ascii_words]
        if others:
            found = self.tokenizer.normalizer.normalize_str(" ".join(others)).split(" ")
            if len(found) == len(others):
                normal += found
            else:  # one became white space
                odd, others = odd + others, []
        flat, sizes = self._alone(odd)
        parts, lengths = [flat], [np.array(sizes, np.int64)]
        if normal:
            codes, pieces = distinct(pa.array(self.split.findall(" ".join(normal)), pa.string()))
            pieces = strings(pieces)
            space = pieces.index(" ") if " " in pieces else -1
            rows = np.zeros(len(pieces), np.int64)
            real = np.arange(len(pieces)) != space
            rows[real] = self.pieces.rows([x for x in pieces if x != " "], self._piece_ids)
            inside = codes != space
            flat, at = self.pieces.gathered(rows[codes[inside]])
            # Pieces before each space, and so the ids of each word.
            bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)[~inside], [inside.sum()]])
            parts.append(flat), lengths.append(np.diff(at[bounds]))
        return odd + ascii_words + others, np.concatenate(parts), np.concatenate(lengths)

    def _rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the words of all texts, where each text's begin, and the last one's end).

        A slice's distinct words are found by Arrow, so Python sees each of them once."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        codes, words = distinct(split.flatten())
        rows = self.words.rows(strings(words), self._word_ids)[codes]
        return rows, np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        rows, docs = self._rows(texts)
        flat, at = self.words.gathered(rows)
        raw, ends = flat.tobytes(), (at[docs] * 4).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        rows, docs = self._rows(texts)
        return np.diff(np.concatenate([[0], np.cumsum(np.diff(self.words.starts)[rows])])[docs])


def _word_pattern(own: dict) -> str:
    """The tokenizer's splitting pattern, if words that a space or a line feed parts can be encoded one by one."""
    kinds = [x.get("type") for x in (own["normalizer"] or {}).get("normalizers", [])]
    split, *rest = (own["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    drops_space = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    if kinds != ["NFC", "Replace", "Lowercase"] or not drops_space or [x["type"] for x in rest] != ["ByteLevel"] or not own["model"]["end_of_word_suffix"]:
        raise ValueError("a tokenizer with NFC, lower case, a splitter that drops white space, and word ends is needed")
    return split["pattern"]["Regex"]


def word_ids(path: str) -> WordIds:
    return worker_tools(("words", path), lambda: WordIds(path))


def encoded(batches, path: str):
    """(slice of the batch, its texts' ids) for every part of every Arrow batch with a text column."""
    codec = word_ids(path)
    for batch in batches:
        for part in slices(batch, SLICE):
            yield part, codec.encode(part.column("text"))


def vocab_size(path: str) -> int:
    return word_ids(path).vocab_size


def id_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)
