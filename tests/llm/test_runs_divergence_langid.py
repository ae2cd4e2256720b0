"""Periodic runs, source divergence and language mixtures against brute force and on every odd table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from meterflow.llm import divergence, langid, periodic

SCHEMA = "doc_id long, text string, lang string, source string, runs string, collapsed string, n string, p string"


def frame(spark, rows):
    """Documents, with columns whose names operators use."""
    return spark.createDataFrame([(*r, "x", "y", "z", None) for r in rows], SCHEMA)


def brute_runs(words, least):
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j > i and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q, q))
            i = j + 1
    return sorted((r for r in out if r[1] - r[0] >= least), key=lambda r: (r[0], r[2]))


def random_words(rng):
    """Texts built of repeats of repeats, with breaks."""
    size, kinds = rng.randint(0, 260), rng.choice([1, 2, 2, 3, 5, 50])
    out = [rng.randrange(kinds) for _ in range(rng.randint(1, 4))]
    while len(out) < size:
        how = rng.random()
        if how < 0.4:
            n = len(out) * rng.randint(1, 4) + rng.randint(0, len(out))
            out = (out * 6)[:n]
        elif how < 0.7:
            out += [rng.randrange(kinds) for _ in range(rng.randint(0, 5))]
        else:
            out += ([rng.randrange(kinds) for _ in range(rng.randint(1, 5))] * 60)[: rng.randint(1, 60)]
    return out[:size]


@pytest.mark.parametrize("least", [1, 12])
def test_all_runs_are_found(least):
    rng = random.Random(least)
    for _ in range(400):
        docs = [random_words(rng) for _ in range(5)]
        found, _ = periodic._searched(np.array(sum(docs, []), np.int64), np.array(list(map(len, docs))), least)
        assert [tuple(r) for r in found.tolist()] == [(d, s, e - s, q) for d, words in enumerate(docs) for s, e, q in brute_runs(words, least)]


def test_fibonacci_words_and_two_highly_periodic_neighbours():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    for words in (b, ([0, 1] * 40 + [0]) * 2, ([0] * 90 + [1]) * 3, ([0, 0, 1] * 50 + [0, 0]) * 2 + [5]):
        found, _ = periodic._searched(np.array(words), np.array([len(words)]), 1)
        assert [tuple(r[1:]) for r in found.tolist()] == [(s, e - s, q) for s, e, q in brute_runs(words, 1)]


def test_runs_of_documents(spark):
    rng = random.Random(3)
    texts = [" ".join("abcdefgh"[w % 8] + str(w) for w in random_words(rng)) for _ in range(120)] + [None, "", " \n\t", "x", "one\x0btwo  three", "á b " * 20, "a b\x1cc " * 30]
    ids = [*range(len(texts) - 2), None, 5]
    docs = frame(spark, [(i, t, "l", "s") for i, t in zip(ids, texts)])
    expected = []
    for i, text in zip(ids, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = brute_runs(words, 12)
        gone = {j for s, e, q in runs for j in range(s + q, e)}
        best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        expected.append((i, len(runs), *shown, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), digest(" ".join(w for j, w in enumerate(words) if j not in gone))))
    got = [tuple(r) for r in periodic.digests(periodic.find_runs(periodic.with_planted_runs(docs))).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in zip(ids, texts))
    assert periodic.digests(periodic.find_runs(periodic.with_planted_runs(docs.limit(0)))).count() == 0


def brute_divergence(rows, least, top):
    docs = [tuple(x or "" for x in r[1:]) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in docs]
    out = set()
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    for lang in {d[1] for d in docs}:
        mine = [(d[2], t) for d, t in zip(docs, terms) if d[1] == lang]
        kept = [w for w in {w for _, t in mine for w in t} if sum(w in t for _, t in mine) >= least]
        count = lambda words: {w: words.count(w) for w in kept}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        whole = share(count([w for _, t in mine for w in t]))
        counts = {s: count([w for x, t in mine if x == s for w in t]) for s in {s for s, _ in mine}}
        p = {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s)
            own = sorted((-f(p[s][w], whole[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > whole[w])[:top]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)} | {(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(own)}
    return out


def test_divergence_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = ["The", "the", "é", "Été", "ab", "x1y", "a_b", "漢字", "zz", "Q"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 8]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None, "S"])) for i in range(150)]
    rows += [(None, None, None, "s9"), (7, "a b c", "xx", "s1"), (7, "a b c", "xx", "s2"), (8, "", "en", "s1"), (8, "", "en", "none")]
    docs = frame(spark, rows)
    for block, least in ((20_000, 10), (5, 10), (7, 1)):
        monkeypatch.setattr(divergence, "BLOCK", block)
        got = divergence.audit(docs, least_docs=least)
        assert {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect()} == brute_divergence(rows, least, 10)
    assert divergence.audit(docs.limit(0)).count() == 0
    nothing = divergence.audit(frame(spark, [(1, None, "en", "a"), (2, None, "en", "b")])).collect()
    assert {tuple(r) for r in nothing} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_shares_of_counts_beyond_64_bits(spark):
    n, total, kept = 9_223_372_036_854, 98_765_432_109_876, 1_000_003
    got = spark.sql(f"SELECT {n}L AS n, {total}L AS total, {kept}L AS kept").select(divergence.share(*map(divergence.F.col, ("n", "total", "kept")))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


SOUNDS = {"aa": "ka la ma na ra ta".split(), "bb": "sch tch ung eit ich ach".split(), "cc": "ίο ντα κει στο πρα λον".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_and_mixtures(spark):
    rng = random.Random(5)
    rows = [(i, speech(rng, lang, rng.randint(3, 60)), lang, "s") for i in range(400) for lang in [rng.choice(list(SOUNDS))]]
    odd = [(9001, None, "aa", "s"), (9002, "", "aa", "s"), (9003, "12 34 !?", "bb", "s"), (None, speech(rng, "bb", 20), "zz", "s"), (9004, speech(rng, "cc", 20), None, "s"), (9004, speech(rng, "cc", 20), None, "s")]
    mixed = [(9100 + i, speech(rng, "aa", 60) + ". " + speech(rng, "bb", 60), None, "s") for i in range(10)] + [(9200, speech(rng, "cc", 30_000), None, "s")]
    docs = frame(spark, rows + odd + mixed)
    model = langid.train(docs)
    assert model.languages == ["aa", "bb", "cc"]  # zz stands at a row without an id
    out = langid.predict(docs, model).collect()
    found = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows + odd + mixed) and all(0 <= r["score"] <= 1 for r in out)
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, *_ in rows if found[i]["held_out"]} == set(held)
    assert np.mean([found[i]["lang_pred"] == dict((r[0], r[2]) for r in rows)[i] for i in held]) > 0.97
    assert [found[i]["lang_pred"] for i in (9001, 9002, 9003, None, 9004, 9200)] == ["und", "und", "und", "bb", "cc", "cc"]
    assert [found[i]["score"] for i in (9001, 9002, 9003)] == [0, 0, 0] and not found[None]["held_out"]
    for i in range(10):
        shares = {x["lang"]: x["share"] for x in found[9100 + i]["languages"]}
        assert set(shares) == {"aa", "bb"} and abs(shares["aa"] - 0.4) < 0.2
    assert all(len(found[i]["languages"]) == 1 for i in held)


def test_language_scores_ignore_labels(spark):
    rng = random.Random(6)
    rows = [(i, speech(rng, lang, 20), lang, "s") for i in range(80) for lang in [rng.choice(list(SOUNDS))]]
    docs = frame(spark, rows)
    changed = frame(spark, [(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "other") for i, t, lang, _ in rows])
    get = lambda df: sorted(map(tuple, langid.predict(df, langid.train(df)).select("doc_id", "lang_pred", "score").collect()))
    assert get(docs) == get(changed)
    empty = docs.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}
