"""Secret scans in DataFrame functions alone.

Three base patterns find assignments, access keys and hexadecimal strings. Two character Markov models add spans: one of
random strings, one of ordinary identifiers. Their labelled samples come from the whole corpus: the values of
base matches are random, other long runs of letters (with a few digits at the end at most) and of digits in groups (dates, numbers) are ordinary. Bigrams are counted in
Spark (at most 80 * 80 of each label reach the driver) and smoothed by how often the second character occurs at all. Every run
is scored: one whose log-likelihood ratio reaches LEAST_RATIO is a span of kind ``random`` unless it overlaps a base span.

Spans are (kind, start, end), in code points, end exclusive. Cases: NULL text is the empty text, without spans. Equal and NULL
ids are rows of their own. Without any sample both models are uniform and nothing is added. ``scan`` ignores
other columns; ``redact`` keeps them. Empty tables give empty tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import as_rows, texts_of

#: Kinds and their patterns, in the order of listing.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"^([A-Za-z+/_=-]+[0-9]{0,4}|[0-9+/_=-]+)$"
#: Natural log of the ratio that a run must reach, the weight of smoothing, and the share of
#: the random strings' model that is uniform over the alphabet (base matches are mostly hexadecimal, random strings need not be).
LEAST_RATIO, SMOOTHING, UNIFORM = 12.0, 0.5, 0.5
#: The first character code of the models' alphabet and its size.
FIRST, SIZE = 43, 80
BLOCK = 64


def _spans(kind: int, text: Column, pattern: str, keep) -> Column:
    """array<struct<start, kind, end>> of the matches that keep(index) accepts, from the pieces between the matches."""
    return F.when(F.size("_m") > 0, _placed(kind, keep)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def _placed(kind: int, keep) -> Column:
    """Starts are sums of lengths of pieces and matches: whole blocks of them, then the rest of a block."""
    each = F.col("_each")
    at = lambda i: _total(F.slice("_blocks", F.lit(1), F.floor(i / BLOCK).cast("int"))) + _total(F.slice(each, F.floor(i / BLOCK).cast("int") * BLOCK + 1, F.pmod(i, F.lit(BLOCK)))) + F.length(F.get("_p", i))
    indexes = F.filter(F.sequence(F.lit(0), F.size("_m") - 1), keep)
    made = F.transform(indexes, lambda i: F.struct(at(i).alias("start"), F.lit(kind).alias("kind"), (at(i) + F.length(F.get("_m", i))).alias("end")))
    return made.cast("array<struct<start:int,kind:int,end:int>>")


def _with_spans(df: DataFrame, out: str, kind: int, pattern: str, group: int | None = None, least: int = 0, hint: Column | None = None) -> DataFrame:
    """df and a column of the spans of one kind; the match (or its group) must have the least length."""
    text, every = F.col("_text"), list(dict.fromkeys([*df.columns, out]))
    hit = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
    found = df.withColumn("_hit", hit)
    none = F.array().cast("array<string>")
    found = found.withColumns({"_m": F.when(F.col("_hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), "_p": F.when(F.col("_hit"), F.split(text, pattern, -1)).otherwise(none), "_g": F.when(F.col("_hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else none})
    found = found.withColumn("_each", F.when(F.size("_m") > 0, F.transform(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: F.length(F.get("_p", i)) + F.length(F.get("_m", i)))).otherwise(F.array().cast("array<int>")))
    found = found.withColumn("_blocks", F.when(F.size("_m") >= BLOCK, F.transform(F.sequence(F.lit(0), F.floor(F.size("_m") / BLOCK).cast("int") - 1), lambda b: _total(F.slice("_each", b * BLOCK + 1, F.lit(BLOCK))))).otherwise(F.array().cast("array<int>")))
    keep = (lambda i: F.length(F.get("_g", i)) >= least) if group else (lambda i: F.lit(True))
    found = found.withColumn(out, _spans(kind, text, pattern, keep))
    if group:
        found = found.withColumn("_values", F.filter("_g", lambda x: F.length(x) >= least))
        every.append("_values")
    elif out == "_runs":
        found = found.withColumn("_run_texts", F.col("_m"))
        every.append("_run_texts")
    return found.select(*every)


def base_spans(df: DataFrame) -> DataFrame:
    """Adds _assign, _access and _hex (arrays of spans), and _values (what was assigned), to rows with _text."""
    df = _with_spans(df, "_assign", 0, ASSIGN, group=2, least=12)
    df = _with_spans(df, "_access", 1, ACCESS, hint=F.contains("_text", F.lit("AKIA")))
    return _with_spans(df, "_hex", 2, HEX)


def _bigrams(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))


def train(texts: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of characters, by (first code - FIRST) * SIZE + second code - FIRST, from
    the rows' _text."""
    rows = _with_spans(base_spans(texts.select("_text")), "_runs", 3, RUN)
    inside = lambda s: F.exists(F.concat("_assign", "_access", "_hex"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    pairs = F.zip_with("_runs", "_run_texts", lambda s, t: F.struct(inside(s).alias("random"), t.alias("run")))
    pairs = F.filter(pairs, lambda p: p["random"] | p["run"].rlike(ORDINARY))
    labelled = F.concat(pairs, F.transform("_values", lambda v: F.struct(F.lit(True).alias("random"), v.alias("run"))))
    runs = rows.select(F.explode(labelled).alias("x")).select("x.random", "x.run")
    counts = runs.select("random", F.explode(_bigrams(F.col("run"))).alias("pair")).groupBy("random", "pair").count()
    seen = {True: {}, False: {}}
    for r in counts.collect():  # at most two labels times the pairs of the alphabet
        seen[r["random"]][r["pair"]] = r["count"]
    alphabet = [chr(FIRST + i) for i in range(SIZE)]
    used = [c for c in alphabet if c.isalnum() or c in "+/_=.-"]
    out = [0.0] * (SIZE * SIZE)
    total = lambda table, i, c: sum(n for p, n in table.items() if p[i] == c)
    first = {label: {a: total(table, 0, a) for a in used} for label, table in seen.items()}
    second = {label: {b: (total(table, 1, b) + SMOOTHING) / (sum(table.values()) + SMOOTHING * len(used)) for b in used} for label, table in seen.items()}
    for a in used:
        for b in used:
            likely = {label: (table.get(a + b, 0) + SMOOTHING * second[label][b]) / (first[label][a] + SMOOTHING) for label, table in seen.items()}
            likely[True] = (1 - UNIFORM) * likely[True] + UNIFORM / len(used)
            out[(ord(a) - FIRST) * SIZE + ord(b) - FIRST] = math.log(likely[True] / likely[False])
    return out


def _ratio(token: Column, model: Column) -> Column:
    code = lambda i: F.ascii(F.substring(token, i, F.lit(1))) - FIRST
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(model, code(i) * SIZE + code(i + 1)))


def _scanned(df: DataFrame, model: list[float] | None) -> DataFrame:
    """Adds _base and _spans, both ordered by start and kind, to rows with _text."""
    ratios = F.expr("array(" + ",".join(f"{x:.6f}D" for x in (train(df) if model is None else model)) + ")")
    rows = _with_spans(base_spans(df), "_runs", 3, RUN)
    rows = rows.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    free = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    scored = F.zip_with("_runs", "_run_texts", lambda s, t: F.when(_ratio(t, ratios) >= LEAST_RATIO, s))
    rows = rows.withColumn("_added", F.filter(F.array_compact(scored), free))
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", "_added")))


def _listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row. A model that is not given is trained on df."""
    rows = _scanned(texts_of(df, id_col, text_col).toDF("_id", "_text"), model)
    size = lambda c: F.size(c).cast("long").alias("n" + c)
    return rows.select(F.col("_id").alias("doc_id"), size("_assign"), size("_access"), size("_hex"), F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_spans").alias("spans"))


def redact(df: DataFrame, model: list[float] | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of a text replaced by the mark, overlapping spans by one; a NULL text stays NULL."""
    rows = _scanned(as_rows(df, F.coalesce(F.col(text_col), F.lit("")).alias("_text")), model)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.array_max(F.transform(F.slice("_spans", F.lit(1), i), lambda s: s["end"])))
    piece = lambda s, i: F.when(s["start"] >= before(i), F.concat(F.substring("_text", before(i) + 1, s["start"] - before(i)), F.lit(mark))).otherwise(F.lit(""))
    count = F.size("_spans")
    clean = F.concat(F.array_join(F.transform("_spans", piece), ""), F.substring(F.col("_text"), before(count) + 1, F.length("_text")))
    was = F.col("row").getField(text_col)
    out = rows.withColumn("_clean", F.when(count > 0, clean).otherwise(was))
    return out.select(*[F.col("_clean").alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in df.columns])
