"""Serving queries: equality filters, an inclusive range, an order and a limit, as one function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions import classify
from meterflow.functions.scalars import finite

#: Default and largest limits.
DEFAULT_LIMIT, MOST = 1000, 10_000


def query(df: DataFrame, equal: dict | None = None, between: tuple[str, object, object] | None = None, order: Sequence[str] = (), limit: int = DEFAULT_LIMIT, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that match; None in equal or at an end of the range means no filter. An order column with "-" is descending.

    Filters and columns reach the scan; order and limit become one top-N. Numbers that aren't finite become NULL.
    """
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be 1 to {MOST}")
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    if between:
        name, low, high = between
        df = df if low is None else df.filter(F.col(name) >= low)
        df = df if high is None else df.filter(F.col(name) <= high)
    df = df.select(*columns) if columns else df
    doubles = {c: finite(c) for c, t in df.dtypes if t in ("double", "float")}
    df = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]).limit(limit)
    return df.withColumns(doubles) if doubles else df


def active_advice(advice: DataFrame, system: str | None = None, equal: dict | None = None, limit: int = 100) -> DataFrame:
    """The latest active advice; a system that a row doesn't name is told from its equipment's id."""
    inferred = classify.system_of_equipment(F.col("equipment_id"))
    known = F.coalesce("system_type", inferred) if "system_type" in advice.columns else inferred
    rows = advice.filter("is_active").withColumn("system_type", known)
    return query(rows, {"system_type": system, **(equal or {})}, None, ["-advice_time", "equipment_id", "rule_id"], limit)


def distinct_values(df: DataFrame, *columns: str, fallback: DataFrame | None = None) -> DataFrame:
    """Distinct values in order; from the fallback table if df has none."""
    out = df.select(*columns).distinct()
    if fallback is not None:
        other = fallback.select(*columns).distinct()
        empty = df.select(F.lit(1)).limit(1)
        out = out.unionByName(other.join(empty, how="left_anti"))
    return out.orderBy(*columns)
