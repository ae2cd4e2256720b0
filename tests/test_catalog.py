"""Registered queries against their SQL on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from meterflow import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A part of every group, so that the suite stays short; the driver compares all of them.
NAMES = ["decode_messages", "flatten_change_log", "price_dimension", "extract_dictionary", "upsert_orders", "classify_points", "enrich_facts", "reconcile_orders", "seasonal_profiles", "gap_fill_and_flags", "counter_delta", "proportional_allocation", "hour_grid", "report_day", "report_week", "chiller_report_month", "data_quality_day", "seasonal_forecast", "revenue_forecast", "advice_rules", "serve_supply_curve", "latest_snapshot", "governance_gate", "recompute_affected", "point_fact", "minute_status", "system_hours", "future_features", "serve_advice", "revenue_reconciliation", "lake_statistics", "scaled_report_workload", "scaled_latest_workload", "scaled_feature_workload"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, str)):
        return x
    return float(f"{float(x):.9g}") + 0.0 if isinstance(x, (int, float, decimal.Decimal)) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    found = oracle.sql(catalog.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES


def test_filters_and_columns_reach_the_scan(spark):
    from meterflow.plans import serve

    df = serve.query(spark.read.parquet(f"{FOLDER}/lineitem.parquet"), {"l_returnflag": "A"}, ("l_quantity", 10, 20), ["-l_extendedprice", "l_orderkey"], 5, ["l_orderkey", "l_extendedprice"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" in plan.split("PushedFilters")[1] and "l_comment" not in plan and "TakeOrderedAndProject" in plan
