"""Sinks: appended streams, partitioned tables, dimensions and control tables, below a lake's root."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators.upsert import exists, new_rows


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (``spark.checkpoint.dir``); on a single machine without the setting, one of its own."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{known or 'file://' + tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Lake:
    """Paths of tables: the full lake and the stream lake hold the same tables apart."""

    root: str
    mode: str = "full"

    def path(self, table: str) -> str:
        return f"{self.root}/{self.mode}/{table}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(self.path(table))

    def other(self, mode: str) -> Lake:
        return Lake(self.root, mode)


def append_stream(df: DataFrame, path: str, checkpoint: str, partition_by: tuple = ("dt",), every: str | None = None):
    """Start an appending, checkpointed stream; without an interval it takes what is there and ends."""
    writer = df.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(path)


def overwrite(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace a table and its schema; rows of a partition are written by few tasks."""
    (df.repartition(*partition_by) if partition_by else df).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def copy_if_missing(spark: SparkSession, source: Lake, target: Lake, table: str) -> bool:
    """Copy a dimension into another lake unless it is there; whether it has been copied. A missing source is an error."""
    if exists(spark, target.path(table)):
        return False
    source.read(spark, table).write.mode("ignore").parquet(target.path(table))
    return True


def read_control(spark: SparkSession, lake: Lake, table: str, schema: str) -> DataFrame:
    """A control table, empty before its first write."""
    path = lake.path(table)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_control(df: DataFrame, lake: Lake, table: str) -> None:
    """Replace a small table, whose rows come through one task."""
    df.coalesce(1).write.mode("overwrite").parquet(lake.path(table))


def partition_price_sync(prices: DataFrame, source_type: str) -> DataFrame:
    """Price rows marked as full or incremental, with their month as partition."""
    return prices.withColumns({"source_type": F.lit(source_type), "ym": F.date_format(F.try_to_timestamp(F.col("updated_at").cast("string")), "yyyyMM")})


def write_price_sync(prices: DataFrame, path: str, source_type: str) -> None:
    """Write prices below path by month: a full sync replaces the table, an incremental one adds the rows whose id and update are new."""
    spark, rows = prices.sparkSession, partition_price_sync(prices, source_type)
    if source_type == "full" or not exists(spark, path):
        rows.dropDuplicates(["id", "updated_at"]).write.mode("overwrite").partitionBy("ym").parquet(path)
    else:
        new_rows(spark.read.parquet(path), rows, ["id", "updated_at"]).write.mode("append").partitionBy("ym").parquet(path)
