"""Runs of line hashes: kept in order, merged without a sort, reopened by a later call; rows without ids."""

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from meterflow.llm import linededup  # noqa: E402

SCHEMA = "doc_id long, text string"


def dropped(df, **how):
    return {r["doc_id"]: (r["n_dropped"], r["text"]) for r in linededup.dedup_lines(df, **how).collect()}


def test_a_second_call_meets_the_runs_of_the_first(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    first = spark.createDataFrame([(1, "a line of its own\nshared from day one"), (2, "shared from day one\nshort")], SCHEMA)
    assert dropped(first, folder=folder) == {1: (0, "a line of its own\nshared from day one"), 2: (1, "short")}
    second = spark.createDataFrame([(0, "Shared from day one\nnew on day two"), (9, "new on day two")], SCHEMA)
    assert dropped(second, folder=folder) == {0: (1, "new on day two"), 9: (1, "")}
    third = spark.createDataFrame([(20, "new on day two\nA LINE OF ITS OWN"), (21, "only on day three")], SCHEMA)
    assert dropped(third, folder=folder) == {20: (2, ""), 21: (0, "only on day three")}
    assert dropped(first, folder=folder) == {1: (0, "a line of its own\nshared from day one"), 2: (1, "short")}  # once more: it owns them still


def three_runs(spark, fanout):
    docs = spark.createDataFrame([(i, f"line number {i % 40} of all\nand one more {i}") for i in range(120)], SCHEMA)
    lines = linededup.hashed_lines(docs.select(*linededup._document("text", "doc_id")))
    runs = linededup.Runs(spark, fanout=fanout)
    for first in (0, 40, 80):
        runs.add(lines.filter(F.col("doc").between(first, first + 39)))
    return runs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_three_runs_are_merged_where_they_lie(spark):
    runs = three_runs(spark, fanout=9)
    assert len(runs.tables()) == 3
    with runs.reading(by_row=True):
        merged = runs._merged(runs.tables())
        plan = plan_of(merged)
        assert plan.count("Bucketed: true") == 3 and "Sort [" not in plan and "Exchange" not in plan, plan
        assert merged.rdd.getNumPartitions() == int(runs.NAME.search(runs.tables()[0])[2])
    assert merged.count() == 160 and merged.select("hi", "lo").distinct().count() == 160


def test_a_merged_run_has_a_sorted_file_a_bucket(spark):
    runs = three_runs(spark, fanout=3)  # the third run of a level: all become one
    (name,) = runs.tables()
    buckets = int(runs.NAME.search(name)[2])
    files = spark.read.parquet(f"{runs.path}/{name}").withColumn("file", F.input_file_name())
    assert 1 < files.select("file").distinct().count() <= buckets
    for r in files.groupBy("file").agg(F.collect_list(F.struct("hi", "lo")).alias("rows"), F.count_distinct(F.pmod(F.hash("hi", "lo"), F.lit(buckets))).alias("of")).collect():
        assert r["of"] == 1 and r["rows"] == sorted(r["rows"])
    with runs.reading():
        met = spark.table(name).hint("merge").join(spark.table(name).select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")
        assert "Exchange" not in plan_of(met) and "Sort [" not in plan_of(met) and met.count() == 0
    assert runs.close().count() == 160


def test_runs_of_other_numbers_of_buckets_are_merged(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    docs = spark.createDataFrame([(i, f"line number {i % 40} of all\nand one more {i}") for i in range(120)], SCHEMA)
    lines = linededup.hashed_lines(docs.select(*linededup._document("text", "doc_id")))
    runs = linededup.Runs(spark)
    try:
        for n, first in ((3, 0), (5, 40), (4, 80)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            runs.add(lines.filter(F.col("doc").between(first, first + 39)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (name,) = runs.tables()
    assert runs.NAME.search(name)[2] == "5" and runs.close().count() == 160


def test_a_call_reads_owners_of_its_own_ids_only(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    old = spark.createDataFrame([(i, f"an old line {i}\nanother line {i % 7}") for i in range(90)], SCHEMA)
    assert sum(n for n, _ in dropped(old, folder=folder).values()) == 83
    new = spark.createDataFrame([(200, "an old line 3\na new line"), (201, "a new line"), (None, "another line 5\nof no id at all")], SCHEMA)
    owned = linededup._owned(new.select(*linededup._document("text", "doc_id")), 1, 10, folder)
    assert "PushedFilters: [Or(IsNull(doc)" in plan_of(owned)
    assert sorted((r["doc"] or -1, len(r["owned"])) for r in owned.collect()) == [(-1, 1), (200, 1)]


def test_rows_without_ids_are_documents_of_their_own(spark):
    n = 10_000
    rows = [(None, f"a line of row {i} alone\nthe same line in all rows") for i in range(n)] + [(7, "the same line in all rows\nanother long line")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = linededup.dedup_lines(df)
    counts = {(r["doc_id"], r["n_dropped"]): r["count"] for r in out.groupBy("doc_id", "n_dropped").count().collect()}
    assert counts == {(7, 0): 1, (None, 1): n}


def test_rows_of_one_id_are_told_apart_by_their_text(spark):
    rows = [(3, "one long line\nshared by some"), (3, "shared by some\nother long line"), (3, "shared by some\nother long line"), (4, "other long line")]
    out = sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    texts = [t for i, t in out if i == 3]
    assert sum("shared by some" in t for t in texts) in (1, 2) and out[-1] == (4, "")
    assert out == sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows[::-1], SCHEMA)).collect())


def test_the_largest_id_is_an_id(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(top, "a line that two have"), (5, "a line that two have"), (None, "a line that two have")], SCHEMA)
    assert dropped(df) == {top: (1, ""), 5: (0, "a line that two have"), None: (1, "")}
