"""How far the sources of a language differ in their terms, and which terms set each source apart.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. A language keeps the V terms that at least ``LEAST_DOCS`` of its
documents hold. A group (a language's source, or the language) gives each kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the sum of
its counts of kept terms; two groups differ on a term by f = floor((p - q)^2 / (p + q)). All arithmetic is on whole numbers.

Method (Gustavson's row-wise product). The kept terms' postings are stored once, term by term, in blocks of about ``BLOCK`` postings. In a
block, each group's row scatters the postings of its terms into a dense accumulator with a cell for each peer, so that no pair
of postings is ever a row. A term that a group lacks has that group's baseline there (its p at count 0): the accumulator takes what both
having the term adds over the baselines, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), and what the baselines alone give comes from a
histogram of each group's p: V f(p0, q0) + sum of f(p, q0) - f(p0, q0) over the group's terms, and the same the other way round.

Scale: terms are counted in the workers, slice by slice, and summed map-side before they move, so frequent words and hot sources are a row a task and
source. Blocks bound what a task holds. The result has a row for each ordered pair of a language's sources, as asked for.

Cases: NULL text, language and source count as ''. A group without kept terms has V times the baselines' difference; with V = 0 all
values are 0. Repeated rows are documents of their own, ids don't matter, other columns neither. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import slices, stored, texts_of

LEAST_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Postings of a block, and bytes of text that are counted together.
BLOCK, SLICE = 20_000, 12_000_000
#: Lower case for A-Z, itself for a-z and bytes beyond ASCII, a space for all others.
_TERM_BYTES = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number and term code of every occurrence, distinct terms)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_TERM_BYTES[data]))
    split = pc.ascii_split_whitespace(clean)
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return owner, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, sums of each of the values)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _counted(texts: list[pa.Array], groups: list[tuple[str, str]]) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some texts, and a row with a NULL term for each group."""
    names = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    group = np.array([names[g] for g in groups], np.int64)
    owner, code, terms = _terms(pa.concat_arrays(texts))
    keys, n = _sums(owner * max(1, len(terms)) + code, np.ones(len(code), np.int64))
    keys, n, docs = _sums(group[keys // max(1, len(terms))] * max(1, len(terms)) + keys % max(1, len(terms)), n, np.ones(len(n), np.int64))
    group, code = keys // max(1, len(terms)), keys % max(1, len(terms))
    group = np.concatenate([group, np.arange(len(names))])
    lang, source = (pa.array([g[i] for g in names], pa.string()).take(pa.array(group)) for i in range(2))
    term = pa.concat_arrays([terms.take(pa.array(code)), pa.nulls(len(names), pa.string())])
    more = np.zeros(len(names), np.int64)
    return pa.RecordBatch.from_arrays([lang, source, term, pa.array(np.concatenate([n, more])), pa.array(np.concatenate([docs, more]))], ["lang", "source", "term", "n", "docs"])


def term_counts(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a NULL term with 0 for each group."""

    def run(batches):
        texts, groups, size = [], [], 0
        for batch in batches:
            for part in slices(batch, SLICE):
                text = part.column("text")
                if size + text.nbytes > SLICE and texts:
                    yield _counted(texts, groups)
                    texts, groups, size = [], [], 0
                texts.append(text)
                groups += zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
                size += text.nbytes
        if texts:
            yield _counted(texts, groups)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    rows = texts_of(df.select(F.lit(None).alias("doc_id"), F.col(text_col).alias("text"), *named), extra=("lang", "source")).drop("doc_id")
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    """The whole part of a quotient of whole numbers, exact."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a count; in decimals, as 10^9 times a count may be beyond 64 bits. NULL if no term is kept."""
    return F.when(kept > 0, 1 + _div((n + 2).cast("decimal(20,0)") * F.lit(SCALE), (total + 2 * kept).cast("decimal(20,0)")))


def difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its peers by summed difference (``pair``, all of them), and the terms it has
    more often than its language (``term``, the first few)."""
    counts = stored(term_counts(df, lang_col, source_col, text_col), "terms")
    term = Window.partitionBy("lang", "term")
    kept = counts.filter("term IS NOT NULL").withColumns({"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    postings = stored(kept.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"), "postings")
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"), F.count(F.lit(1)).alias("n_postings"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["total", "firsts", "n_postings"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("kept"), F.sum("n_postings").alias("lang_postings"))
    groups = stored(groups.join(langs, "lang").withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "groups")
    known = postings.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "zero",
        F.pmod(F.xxhash64("term"), F.ceil(F.col("lang_postings") / BLOCK)).alias("block"),
    )
    return _pairs(known, groups).unionByName(_apart(known, top))


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _apart(known: DataFrame, top: int) -> DataFrame:
    """The terms of each group that it has more often than its language, those that differ most first."""
    more = known.filter("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    return _ranked(more, "term").filter(F.col("rank") <= top)


def _pairs(known: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of a language's sources with its summed difference."""
    blocks = known.select("lang", "block", "source", "term", "p", "zero").groupBy("lang", "block").applyInArrow(_accumulated, "lang string, source string, item string, value long")
    every = blocks.unionByName(_baselines(known, groups)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(every, "pair")


def _baselines(known: DataFrame, groups: DataFrame) -> DataFrame:
    """What the baselines give each pair, and what each side's terms add over the other side's baseline."""
    steps = known.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    steps = steps.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("steps"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "zero")).alias("peers"))
    rows = groups.select("lang", "source", "zero", "kept").join(steps, ["lang", "source"], "left").join(peers, "lang")
    rows = rows.withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<p: bigint, terms: bigint>>")))

    def cells(peer: Column) -> Column:
        both = F.coalesce(difference(F.col("zero"), peer["zero"]), F.lit(0))
        own = F.aggregate("steps", F.lit(0).cast("long"), lambda x, s: x + s["terms"] * (difference(s["p"], peer["zero"]) - both))
        here = F.struct(F.col("source").alias("source"), peer["source"].alias("item"), (own + F.col("kept") * both).alias("value"))
        return F.array(here, F.struct(peer["source"].alias("source"), F.col("source").alias("item"), own.alias("value")))

    others = F.filter("peers", lambda peer: peer["source"] != F.col("source"))
    return rows.select("lang", F.inline(F.flatten(F.transform(others, cells))))


def _accumulated(block: pa.Table) -> pa.Table:
    """A block's rows times itself: for each group what the terms it shares with each peer add over the baselines."""
    block = block.combine_chunks()
    source, term = (block.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    names, group = source.dictionary, source.indices.to_numpy(zero_copy_only=False)
    term = term.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    group, term, p = group[order], term[order], block.column("p").to_numpy()[order]
    sizes = np.bincount(term)
    starts = np.cumsum(sizes) - sizes
    zero = np.zeros(len(names), np.int64)
    zero[group] = block.column("zero").to_numpy()[order]
    f = lambda a, b: (a - b) * (a - b) // (a + b)
    rows, peers, values = [], [], []
    by_group = np.argsort(group, kind="stable")
    for g, own in enumerate(np.split(by_group, np.cumsum(np.bincount(group))[:-1])):
        n = sizes[term[own]]
        at = np.repeat(starts[term[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        peer, mine, theirs = group[at], np.repeat(p[own], n), p[at]
        more = f(mine, theirs) - f(mine, zero[peer]) - f(zero[g], theirs) + f(zero[g], zero[peer])
        cell = np.zeros(len(names), np.int64)
        np.add.at(cell, peer, more)
        cell[g] = 0
        full = np.flatnonzero(cell)
        rows.append(np.full(len(full), g)), peers.append(full), values.append(cell[full])
    rows, peers = (names.take(pa.array(np.concatenate(x))) for x in (rows, peers))
    lang = pa.array([block.column("lang")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(rows), np.int64)))
    return pa.table([lang, rows, peers, pa.array(np.concatenate(values))], ["lang", "source", "item", "value"])
