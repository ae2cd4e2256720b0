"""Near duplicates by fingerprints against brute force, in groups with many texts before them in their buckets."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from meterflow.llm import fingerprint  # noqa: E402

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"z{rng.randrange(10**9)}"
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and 4 * both >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_links_are_found_behind_smaller_texts(spark):
    rng = random.Random(3)
    rows = []
    for k in range(4):  # two texts that are alike share only what smaller texts of their group, which are not alike to them, share too
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(1000 + 2 * k, " ".join(changed(rng, base, 2))), (1001 + 2 * k, " ".join(changed(rng, base, 5)))]
        rows += [(60 * k + i, " ".join(changed(rng, base, 16))) for i in range(60)]
    rows += [(5000, rows[0][1]), (5001, ""), (5002, " \t "), (5003, None)]
    sets = {i: shingle_set(t) for i, t in rows}
    want = brute_components(sets)
    assert all(want[1000 + 2 * k] == want[1001 + 2 * k] for k in range(4))
    df = spark.createDataFrame(rows, SCHEMA)
    links = fingerprint.near_pairs(df).collect()
    for r in links:
        assert r["a"] < r["b"] and len(sets[r["a"]] & sets[r["b"]]) == r["intersection"] and len(sets[r["a"]] | sets[r["b"]]) == r["union"]
    found = {(r["a"], r["b"]) for r in links}
    assert found >= {(1000 + 2 * k, 1001 + 2 * k) for k in range(4)}, found
    _, members = fingerprint.near_duplicates(df)
    got = {r["doc_id"]: (r["class_id"], r["component_id"]) for r in members.collect()}
    assert {i: c for i, (_, c) in got.items()} == want
    assert got[5000][0] == min(i for i in sets if sets[i] == sets[5000]) and got[5003] == (5003, 5003)


def test_equal_fingerprints_of_other_sets_are_verified(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        words = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed(rng, words, 1)))]
    df = spark.createDataFrame(rows, SCHEMA)
    links = {(r["a"], r["b"]): (r["intersection"], r["union"]) for r in fingerprint.near_pairs(df).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    assert links == {(2 * k, 2 * k + 1): (len(sets[2 * k] & sets[2 * k + 1]), len(sets[2 * k] | sets[2 * k + 1])) for k in range(12)}, len(links)


def test_rows_without_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(None, one), (None, two), (4, one), (4, two), (9, two + " more")], SCHEMA)
    links, members = fingerprint.near_duplicates(df)
    assert [tuple(r) for r in links.collect()] == [(4, 9, 56, 57)]
    assert sorted((r["doc_id"] or 0, r["class_id"], r["component_id"]) for r in members.collect()) == [(0, 4, 4), (0, 4, 4), (4, 4, 4), (4, 4, 4), (9, 9, 4)]
    assert all(x.count() == 0 for x in fingerprint.near_duplicates(df.limit(0)))
