"""Every stage of the pipeline against brute force on the rows that the stage before has kept; the models' spans against plain Python."""

import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from meterflow.llm import quality, secrets  # noqa: E402

SPACE = " \t\n\x0b\x0c\r"


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def without_lines(texts):
    owner, key = {}, lambda line: line.strip(SPACE).lower()
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            owner.setdefault(key(line), i)
    return {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i) for i, t in texts.items()}


def without_copies(texts):
    root, sets = {i: i for i in texts}, {i: shingles(t) for i, t in texts.items()}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in texts.items() if find(i) == i}


def redacted(text, listed):
    """The text with the listed spans (kind:start:end) replaced, overlapping ones by one mark."""
    out, at, spans = [], 0, sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in listed.split(",") if s))
    for start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(900)]
    prose = lambda n: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 30))).capitalize() for _ in range(n))
    rows = []
    for i in range(150):
        text = prose(rng.randint(2, 12))
        if i % 10 == 3:
            text = rng.choice(["BUY!! NOW!! ", "same same ", "a### b$$$ c%%% "]) * rng.randint(20, 60)
        elif i % 10 == 4 and i > 20:
            words = rows[i - 13][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif i % 10 == 5:
            text += "\nA line that many documents have\nshort\n" + prose(1)
        elif i % 10 == 6:
            text += f' token = "{"".join(rng.choice("0123456789abcdef") for _ in range(24))}" and more'
        rows.append((i, text, i % 10 != 3))
    rows += [(900, "", True), (901, rows[0][1], True), (902, None, True)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(q), 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_does_what_brute_force_does(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    frame = docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}

    model = quality.train(docs, labels)
    accepted = {i: t for i, t in held.items() if quality.scores(model, [t or ""])[0] >= quality.THRESHOLD}
    brute = {
        "quality classifier": lambda _: accepted,
        "line dedup": lambda texts: {i: t and without_lines({k: x or "" for k, x in texts.items()})[i] for i, t in texts.items()},
        "minhash near-dedup": lambda texts: {i: texts[i] for i in without_copies({k: x or "" for k, x in texts.items()})},
    }
    for name, expected in brute.items():
        want = expected(held)
        frame = stages[name](spark, frame, folder)
        held = {r["doc_id"]: r["text"] for r in frame.collect()}
        assert held == want and frame.columns == docs.columns, name
    assert 100 < len(held) < 150

    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(frame).collect()}
    frame = stages["secret scans"](spark, frame, folder)
    clean = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert clean == {i: None if t is None else redacted(t, spans[i]) for i, t in held.items()} and sum("[SECRET]" in (t or "") for t in clean.values()) >= 10

    packed = stages["best-fit packing"](spark, frame, folder).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    found, placed = Counter(), defaultdict(list)
    for r in packed:
        found[r["doc_id"]] += r["length"]
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == lengths
    for parts in placed.values():  # no gap, no overlap, not too long
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    assert len(placed) == -(-sum(lengths.values()) // 2048)
    whole = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert whole == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_added_spans_are_those_whose_ratio_reaches_the_bound(spark):
    import re

    rng, generator = random.Random(4), np.random.default_rng(4)
    model = generator.normal(0.4, 1.5, secrets.SIZE**2).round(6).tolist()
    letters = string.ascii_letters + string.digits + "+/_=-"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(10, 40))) for _ in range(rng.randint(0, 8))) for _ in range(60)] + ["", "é" + "a1" * 12 + "é"]

    def ratio(run):
        code = [ord(c) - secrets.FIRST for c in run]
        return sum(model[a * secrets.SIZE + b] for a, b in zip(code, code[1:]))

    want = {}
    for i, text in enumerate(texts):
        base = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
        runs = [m for m in re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        want[i] = [f"random:{m.start()}:{m.end()}" for m in runs if ratio(m[0]) >= secrets.LEAST_RATIO and not any(a < m.end() and m.start() < b for a, b in base)]
    out = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("random")] for r in out}
    assert got == want and 20 < sum(map(len, want.values()))
