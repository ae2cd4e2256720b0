"""Tokenisation, packing, token files and counts against the libraries and brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from meterflow.llm import bpe, packing, tokenbin, tokencounts  # noqa: E402
from meterflow.llm.wordtok import WordIds  # noqa: E402

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "Hello  world \n it's 12,5 é", None, " lead and trail ", "a\tb\x1cc", "  ", "x" * 900 + " end", "same words same words", "same words same words", "<|endoftext|> İß Σς", "\n\n a\n"]
SCHEMA = "text string, doc_id long, ids string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    """Clashing column names, a NULL id, repeated rows."""
    return spark.createDataFrame([(t, i if i != 4 else None, "x", "y") for i, t in enumerate(TEXTS)] + [("dup", 1, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids_of(hf, text):
    return hf.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_ids_match_the_library(hf):
    rng = random.Random(1)
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice("ab Cé'1.\n\t,Σ漢 ") for _ in range(60)) for _ in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordIds(WORDS).encode(pa.array(texts))] == [ids_of(hf, x) for x in texts]


def test_bpe_round_trip_matches_tiktoken(spark, docs):
    import tiktoken

    codec = bpe.codec(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice("ab cé's1. \n\t,漢\x85") for _ in range(80)) for _ in range(200)]
    ids = codec.encode(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(x) for x in texts]
    assert codec.decode(ids) == [x.encode() for x in texts]
    out = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    assert out == {(r["doc_id"], len(library.encode_ordinary(r["text"] or "")), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect()}
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((r["text"] or "").encode() for r in docs.collect())
    assert bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_packing_covers_every_id_once(spark, docs, hf):
    rows = packing.pack_documents(docs, WORDS, capacity=16, with_ids=True).collect()
    want = sorted(x for r in docs.collect() for x in [(r["doc_id"], ids_of(hf, r["text"]) + [0])] for x in [(x[0] if x[0] is not None else -1, tuple(x[1]))])
    by_doc = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 16 and r["start"] == 16 * r["piece"]
        by_doc.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).extend(r["ids"])
    assert {d: sorted(v) for d, v in by_doc.items()} == {d: sorted(sum((list(i) for e, i in want if e == d), [])) for d, _ in want}
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    assert packing.pack_sizes([6, 7, 3, 4, 10], 10, 4) == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    assert packing.pack_sizes([6, 7, 8, 4], 10, 2) == [(0, 0), (1, 0), (2, 0), (0, 6)]  # bin 1 closed, not 0
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 2048) for _ in range(5000)), reverse=True)
    assert max(b for b, _ in packing.pack_sizes(sizes)) + 1 <= 1.03 * sum(sizes) / 2048


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000).astype("<u4")
    raw = tokenbin.packed(ids, bits)
    assert len(raw) == -(-1000 * bits // 8) and tokenbin.unpacked(raw, bits, 1000).tolist() == ids.tolist()
    assert tokenbin.bits_for(49408) == 16 and tokenbin.bits_for(1) == 1


def test_file_gives_random_access():
    docs = [np.arange(n, dtype="<u4") % 5000 for n in (0, 3, 5000, 1, 9000)]
    sink = io.BytesIO()
    writer = tokenbin.Writer(sink, 13)
    writer.add([1, 2, 3], [x.tobytes() for x in docs[:3]])
    writer.add([4, 5], [x.tobytes() for x in docs[3:]])
    writer.close()
    reader = tokenbin.Reader(pa.BufferReader(sink.getvalue()))
    assert [reader.document(k).tolist() for k in range(5)] == [x.tolist() for x in docs]
    assert reader.ids(4000, 4100).tolist() == np.concatenate(docs)[4000:4100].tolist()


def test_token_files_round_trip(spark, docs, hf):
    rows = tokenbin.round_trip(docs, WORDS).orderBy("start").collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len(ids_of(hf, r["text"])) + 1 for r in docs.collect())
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in rows]
    assert known == sorted(known, key=lambda x: (x is None, x))
    assert sorted(r["ids_crc32"] for r in rows) == sorted(crc(ids_of(hf, r["text"]) + [1]) for r in docs.collect())
    assert tokenbin.round_trip(docs.limit(0), WORDS).count() == 0


def test_counts_answer_every_limit(spark, docs, hf):
    lengths = [len(ids_of(hf, r["text"])) for r in docs.collect()]
    sums = tokencounts.suffix_sums(tokencounts.histogram(tokencounts.lengths(docs, WORDS)))
    for r in sums.collect():
        n = r["n_tokens"]
        assert (r["docs_at_least"], r["tokens_at_least"]) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["lost_tokens"] == sum(lengths) - r["truncated_tokens"]
        assert r["docs_within"] == sum(x <= n for x in lengths)
    assert tuple(tokencounts.truncated_total(sums, 5).first()) == (5, sum(min(x, 5) for x in lengths), sum(x > 5 for x in lengths))
    assert tokencounts.quantiles(sums, 0.5).first()["n_tokens"] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert tokencounts.suffix_sums(tokencounts.histogram(tokencounts.lengths(docs.limit(0), WORDS))).count() == 0
