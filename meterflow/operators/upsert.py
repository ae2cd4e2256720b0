"""Upserts as set algebra on DataFrames. Keys meet null-safely: NULL equals NULL. ``merge`` writes their results into stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Keys = Sequence[str]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def matching(df: DataFrame, other: DataFrame, keys: Keys, how: str = "left_semi") -> DataFrame:
    """Rows of df whose keys other has (left_semi) or lacks (left_anti); an equi-join for Spark."""
    other = other.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    return df.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]), how)


def upsert(target: DataFrame, source: DataFrame, keys: Keys) -> DataFrame:
    """Source rows replace target rows of equal keys; the others are added."""
    return matching(target, source, keys, "left_anti").select(*target.columns).unionByName(source, allowMissingColumns=True)


def new_rows(target: DataFrame, source: DataFrame, keys: Keys) -> DataFrame:
    """One row for each key of source that target lacks: replays add nothing."""
    return matching(source.dropDuplicates(list(keys)), target, keys, "left_anti").select(*source.columns)


def insert_only(target: DataFrame, source: DataFrame, keys: Keys) -> DataFrame:
    return target.unionByName(new_rows(target, source, keys), allowMissingColumns=True)


def replace_groups(target: DataFrame, source: DataFrame, group: Keys) -> DataFrame:
    """All target rows of the groups in source go, then source is added; an empty source changes nothing."""
    return upsert(target, source, group)


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns and types of another table: cast, or NULL where it lacks one."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema])


def union_aligned(df: DataFrame, like: DataFrame, keys: Keys) -> DataFrame:
    """Both tables in like's schema, one row for each key."""
    return like.unionByName(align(df, like)).dropDuplicates(list(keys))
