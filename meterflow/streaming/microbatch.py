"""Streaming: continuous ingest, idempotent micro-batches that recompute what late data touches, cut-over and replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators import joins, merge, upsert
from meterflow.sources import readers, sinks

#: A message by its place in its topic. History has no such place (NULLs): there the point and the time tell readings apart.
PLACE = ["source_topic", "partition_id", "offset_id"]
LINEAGE = ["dt", *PLACE, "point_code", "event_time"]
CONTROL = "job_name string, source_path string, target_path string, last_ingest_time timestamp, last_event_time timestamp, processed_rows bigint, updated_at timestamp"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, max_files: int | None = None, every: str | None = None, fmt: str = "json", **options):
    """Envelopes to the appended table of decoded messages."""
    return sinks.append_stream(readers.decode(readers.stream_envelopes(spark, source, fmt, max_files, **options)), target, checkpoint, ("dt",), every)


def incremental_since(df: DataFrame, column: str, mark) -> DataFrame:
    """Rows beyond a high-water mark; all of them without one."""
    return df if mark is None else df.filter(F.col(column) > F.lit(mark))


def replay(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows of an ingest interval, both ends included."""
    return df.filter(F.col(column).between(F.lit(start), F.lit(end)))


def batch_statistics(df: DataFrame, ingest_time: str = "ingest_time", event_time: str = "event_time") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("processed_rows"), *[f(c).alias(f"{n}_{c}") for c in (ingest_time, event_time) for n, f in (("first", F.min), ("last", F.max))])


def upsert_lineage(spark: SparkSession, batch: DataFrame, path: str, staging: str, keys: list[str] = LINEAGE) -> DataFrame:
    """Add a batch to the fact table; rows that are there already, and repeats, add nothing. Returns the batch as it was staged."""
    return merge.merge_into(spark, path, batch, keys, ("dt",), staging, upsert.insert_only)


def affected_hours(batch: DataFrame, keys: list[str], event_time: str = "event_time") -> DataFrame:
    """Keys and hours whose figures a batch changes: its hours and, for meter advances, the hours after."""
    touched = batch.select(*keys, F.date_trunc("hour", event_time).alias("stat_hour")).distinct()
    return joins.with_next_hour(touched, "stat_hour")


def needed_hours(affected: DataFrame) -> DataFrame:
    """The affected hours and those before, which advances need."""
    return joins.with_next_hour(affected, "stat_hour", back=1, ahead=0)


def affected_periods(affected: DataFrame, named: dict) -> DataFrame:
    """The days, weeks or months above affected hours; named: column for each name of the period."""
    rest = [c for c in affected.columns if c != "stat_hour"]
    return affected.select(*rest, *[c.alias(n) for n, c in named.items()]).distinct()


def window_bounds(start, end, unit: str) -> tuple:
    """A fallback without details: the whole hours, days, weeks or months that an interval of event times meets."""
    return F.date_trunc(unit, start), F.date_trunc(unit, end) + F.expr(f"INTERVAL 1 {unit}")


def recompute(fact: DataFrame, batch: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What build makes of the affected hours, from all facts (also late ones) that these hours need."""
    hours = affected_hours(batch, keys)
    facts = fact.withColumn("stat_hour", F.date_trunc("hour", "event_time"))
    made = build(joins.affected(facts, needed_hours(hours), [*keys, "stat_hour"]).drop("stat_hour"))
    return joins.affected(made, hours, [*keys, "stat_hour"])


def micro_batches(spark: SparkSession, messages: DataFrame, points: DataFrame, fact_path: str, hours_path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], fact_of: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str] = ("station_id",), log_path: str | None = None):  # noqa: B006
    """A query that turns each micro-batch into facts and recomputes the hours it touches. Replays change nothing.

    For plants whose hours need only the hour before and whose reports are made elsewhere; ``propagate`` brings a batch through all tables.
    """
    keys = list(keys)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        facts = fact_of(batch, points)
        upsert_lineage(spark, facts, fact_path, f"{fact_path}_staging")
        needed = needed_hours(affected_hours(facts, keys)).select(F.to_date("stat_hour").alias("dt")).distinct()
        days = [r["dt"] for r in needed.collect()]  # literals, so that only these days' partitions are read
        made = recompute(spark.read.parquet(fact_path).filter(F.col("dt").isin(days)), facts, keys, build) if days else build(facts.limit(0))
        merge.merge_into(spark, hours_path, made, ["dt", *keys, "equipment_id", "stat_hour"], ("dt",), f"{hours_path}_staging")
        if log_path:
            batch_statistics(facts).withColumn("batch", F.lit(number)).write.mode("append").parquet(log_path)
        batch.unpersist()

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark_current(df: DataFrame, job: str, source: str, target: str, ingest_time: str = "ingest_time", event_time: str = "event_time") -> DataFrame:
    """A control row that takes everything up to now as done, without processing it."""
    return df.agg(F.lit(job).alias("job_name"), F.lit(source).alias("source_path"), F.lit(target).alias("target_path"), F.max(ingest_time).alias("last_ingest_time"), F.max(event_time).alias("last_event_time"), F.lit(0).cast("bigint").alias("processed_rows"), F.current_timestamp().alias("updated_at"))


def hourly_stream(readings: DataFrame, keys: list[str], value: str, ts: str = "event_time", lateness: str = "2 hours", unique: list[str] | None = None) -> DataFrame:
    """Tumbling hours on a stream with an explicit lateness; with unique keys, repeats within it are dropped."""
    df = readings.withWatermark(ts, lateness)
    if unique:
        df = df.dropDuplicatesWithinWatermark(unique)
    hours = df.groupBy(*keys, F.window(ts, "1 hour").alias("w")).agg(F.avg(value).alias(f"avg_{value}"), F.max(value).alias(f"max_{value}"), F.count(F.lit(1)).alias("record_count"))
    return hours.select(*keys, F.col("w.start").alias("stat_hour"), f"avg_{value}", f"max_{value}", "record_count")
