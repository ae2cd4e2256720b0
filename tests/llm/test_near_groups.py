"""Near duplicates against brute force: other least similarities, and a large group of edited copies around one text."""

import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

from meterflow.llm import fingerprint, neardup  # noqa: E402

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = text.split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def links(sets, least):
    """Pairs of ids that reach the least similarity, by an inverted index."""
    index, found = defaultdict(list), []
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in index[s])
        found += [(j, i) for j, n in shared.items() if 100 * n >= least * (len(sets[i]) + len(sets[j]) - n)]
        for s in sets[i]:
            index[s].append(i)
    return found


def roots(sets, least):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links(sets, least):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("least", [50, 60, 90])
def test_other_least_similarities(spark, least):
    rng = random.Random(least)
    rows = []
    for k in range(60):  # pairs on either side of the bound
        words = [f"w{k}_{i}" for i in range(300)]
        other = list(words)
        for i in rng.sample(range(300), rng.randint(1, 30)):
            other[i] = f"z{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = {i: shingles(t) for i, t in rows}
    want = roots(sets, least)
    assert 5 < sum(want[i] != i for i in want) < 60
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), least).collect()}
    assert got == want
    _, members = fingerprint.near_duplicates(spark.createDataFrame(rows, SCHEMA), least)
    assert {r["doc_id"]: r["component_id"] for r in members.collect()} == want


def test_a_large_group_of_edited_copies(spark):
    """Copies that keep a stretch of one text: far from it, near to each other, and linked only from neighbour to neighbour."""
    rng = random.Random(8)
    base = [f"b{rng.randrange(10**6)}" for _ in range(160)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):
        kept = rng.randint(60, 160)
        start = rng.randint(0, 160 - kept) if i % 3 else 0
        copy = base[start : start + kept]
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows}
    want = roots(sets, 75)
    assert len(set(want.values())) > 3 and Counter(want.values()).most_common(1)[0][1] > 100
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r["doc_id"]: r["component_id"] for r in out}
    # Every component is one of brute force or a part of it; a link is missed by the minhash estimates once in some thousand.
    assert all(want[got[i]] == want[i] for i in got)
    lost = sum(got[i] != want[i] for i in got)
    assert lost <= 15, lost
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in out)
