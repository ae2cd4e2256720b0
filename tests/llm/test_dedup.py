"""Lines, near duplicates, fingerprints and components against brute force."""

import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")

from meterflow.llm import fingerprint, linededup, neardup  # noqa: E402
from meterflow.llm.components import components  # noqa: E402
from meterflow.llm.shingles import Shingler  # noqa: E402

SCHEMA = "doc_id long, text string, hi string, table int"
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """Rows of (id, text) with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def made_texts(n=120, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            x = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        else:  # copies of one base, edited more or less; one in four is exact
            x = list(base)
            for _ in range((0, 0, 2, 12)[kind] + i % 3):
                x[rng.randrange(len(x))] = rng.choice(words)
        texts.append(" ".join(x))
    return texts


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rows = list(enumerate(made_texts())) + [(200, ""), (201, None), (202, " \n "), (203, "A b"), (204, "a  B"), (205, "a b c d e " * 3000), (206, "a b c d e " * 3000)]
    out = neardup.near_duplicates(frame(spark, rows + [(None, rows[1][1])])).collect()
    expected = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out if r["doc_id"] is not None)
    (alone,) = [r for r in out if r["doc_id"] is None]
    assert alone["component_id"] is None and alone["kept"]
    kept = neardup.without_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "hi", "table"] and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in expected.items() if i == c}
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 60), (100, 61), (61, 62), (7, 7)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert out == {i: 1 for i in range(1, 41)} | {60: 60, 61: 60, 62: 60, 100: 60}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    owner = {}
    for i, t in sorted(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                owner.setdefault(key(x), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or owner[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    pool = ["Short", "  A line that many documents share\t", "a LINE that many documents share", "éÉ non-ascii stays É", "", "exactly10!"] + [f"line number {i} of the pool" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n".join(f"unique line {i}" for i in range(5000)))]
    for batches in (1, 4, 9):
        out = linededup.dedup_lines(frame(spark, rows), batches)
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()} == brute_lines(rows)
    again = {r["doc_id"]: r["text"] for r in linededup.dedup_texts(frame(spark, rows)).collect()}
    assert again[100] is None and {i: t or "" for i, t in again.items()} == {i: x[2] for i, x in brute_lines(rows).items()}


def test_lines_of_repeated_and_null_ids(spark):
    line = "the same line in all of them"
    out = linededup.dedup_lines(frame(spark, [(1, line), (1, line), (None, line), (2, "own line of two")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in out) == [(0, 1), (1, 0), (1, 0), (2, 0)]
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_shingles_match_sets():
    texts = [*made_texts(20), "", "\t", "one", "\x85 a\xa0b c d e f", "A B C D E", "a b c d e"]
    hashes, counts = Shingler().hashes(texts)
    assert counts.tolist() == [len(shingle_set(t)) for t in texts]
    assert hashes[-1] == hashes[-2]


def test_fingerprints_of_edits(spark):
    texts = made_texts(40, 9) + ["", "x", "été"]
    rows = list(enumerate(texts)) + [(100, None)]
    order = [t or "" for _, t in sorted(rows, reverse=True)]
    following = {i: n for (i, _), n in zip(sorted(rows, reverse=True), order[1:] + order[:1])}
    out = fingerprint.compare(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    seen = {}
    for r in out:
        text = dict(rows)[r["doc_id"]] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[r["doc_id"]][:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (shingle_set(x) for x in (text, changed, following[r["doc_id"]]))
        for x, y, near in ((a, b, r["near_edited"]), (a, c, r["near_next"])):
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(near - true) < 0.2
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert fingerprint.compare(frame(spark, [(1, "only one text here")])).first()["near_next"] == 1.0
    assert fingerprint.compare(frame(spark, [])).count() == 0


def test_near_pairs_are_verified(spark):
    rows = list(enumerate(made_texts(60, 2)))
    sets = {i: shingle_set(t) for i, t in rows}
    out = fingerprint.near_pairs(frame(spark, rows)).collect()
    assert out and all(len(sets[r["a"]] & sets[r["b"]]) == r["intersection"] and 4 * r["intersection"] >= 3 * r["union"] for r in out)
