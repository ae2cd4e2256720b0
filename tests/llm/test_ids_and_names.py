"""Rows without ids, the largest id, repeated ids, and columns that are named like what operators use inside."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402

from meterflow.llm import bpe, fingerprint, linededup, neardup, packing, quality, secrets, tokenbin, tokencounts  # noqa: E402

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOP = 2**63 - 1
SCHEMA = "doc_id long, text string"
ROWS = [(TOP, "the last one of all"), (None, "one without an id"), (None, "another without an id"), (4, "a text"), (4, "another text"), (-3, "below zero")]
IDS = sorted((i for i, _ in ROWS), key=str)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_every_id_comes_back(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    made = [
        bpe.round_trip(df, BYTES, public_tokenizers.PATTERN), packing.pack_documents(df, WORDS), linededup.dedup_lines(df), quality.score(df, 0.5), tokenbin.round_trip(df, WORDS),
        neardup.near_duplicates(df), fingerprint.compare(df), secrets.scan(df, [0.0] * secrets.SIZE**2), tokencounts.lengths(df, WORDS), bpe.encode(df, BYTES, public_tokenizers.PATTERN),
    ]
    for out in made:
        assert ids(out) == IDS, out.columns


def test_the_largest_id_takes_part_in_links(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(TOP, text), (8, text + " more"), (None, text)], SCHEMA)
    out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert out == {TOP: (8, False), 8: (8, True), None: (None, True)}


def test_fingerprints_put_rows_without_ids_first(spark):
    rows = [(None, "n" * 10), (2, "b" * 10), (1, "a" * 10), (TOP, "t" * 10)]
    out = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.compare(spark.createDataFrame(rows, SCHEMA)).collect()}
    sha = lambda own, following: hashlib.sha256((own * 5 + following * 5).encode()).hexdigest()
    assert out == {None: sha("n", "t"), TOP: sha("t", "b"), 2: sha("b", "a"), 1: sha("a", "n")}


def test_repeated_ids_are_written_alike_every_time(spark):
    rows = [(i % 5 if i % 7 else None, f"text number {i * 7919 % 101} of many") for i in range(200)]
    made = [[tuple(r) for r in tokenbin.round_trip(spark.createDataFrame(x, SCHEMA).repartition(k), WORDS).orderBy("start").collect()] for x, k in ((rows, 3), (rows[::-1], 5))]
    assert made[0] == made[1] and [r[0] for r in made[0]][-29:] == [None] * 29
    assert all(a[1] + a[2] == b[1] for a, b in zip(made[0], made[0][1:]))


def test_names_of_stores():
    assert tokenbin.pyarrow_uri("s3a://bucket/x") == "s3://bucket/x" and tokenbin.pyarrow_uri("abfss://c@a/x") == "abfs://c@a/x"
    assert tokenbin.pyarrow_uri("/tmp/x") == "file:///tmp/x" and tokenbin.pyarrow_uri("file:/tmp/x") == "file:/tmp/x" and tokenbin.pyarrow_uri("hdfs://n/x") == "hdfs://n/x"


INSIDE = "_doc _text _owned _m _p _g _hit _values _spans _clean _key _id _base _runs _each _blocks _assign _access _hex row key doc part owned text_u head root hi lo batch".split()


def test_columns_named_like_the_operators_own_stay(spark):
    text = 'token = "04dbebab91ab85687d33" stands here\nand a line that others have too'
    columns = ", ".join(f"{c} string" for c in INSIDE)
    rows = [(i, text if i % 2 else f"{text} {i}", *[f"{c}{i}" for c in INSIDE]) for i in range(6)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {columns}")
    clean = secrets.redact(df, [0.0] * secrets.SIZE**2)
    lines = linededup.dedup_texts(df)
    unlike = neardup.without_near_duplicates(df)
    for out in (clean, lines, unlike):
        assert out.dtypes == df.dtypes
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in INSIDE)
    assert clean.count() == lines.count() == 6 and all("[SECRET]" in r["text"] for r in clean.collect())
    assert {r["doc_id"] for r in unlike.collect()} <= set(range(6))


def test_the_registered_digest_of_ids_is_that_of_the_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "plain words here", "  spaces  and\n\nlines \n", "Ünïcödé 漢字 naïve", "x" * 700, "a b " * 300, "it's 12345 <|endoftext|>", "\t tab\u00a0nbsp\u2003em "]
    out = bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), SCHEMA), BYTES, public_tokenizers.PATTERN).collect()
    for r in out:
        want = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_a_rank_file_too_large_is_refused(tmp_path):
    import base64

    path = tmp_path / "big.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)) + f"{base64.b64encode(b'ab').decode()} 70000\n")
    with pytest.raises(ValueError):
        bpe.Codec(str(path), public_tokenizers.PATTERN)
