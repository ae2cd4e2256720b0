"""Streams give what the batch functions give on the same rows, however often a batch is replayed."""

import json

from pyspark.sql import functions as F

from meterflow.functions.classify import classify_points
from meterflow.plans import silver
from meterflow.sources import readers
from meterflow.streaming import microbatch


def _envelopes(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [{"key": s, "value": json.dumps({"sensor_id": s, "timestamp": t, "value": v}), "topic": f"sensor_{s}", "partition": 0, "offset": o, "timestamp": "2024-01-01T00:00:00Z"} for o, s, t, v in rows]
    (folder / name).write_text("\n".join(map(json.dumps, lines)))


def _points(spark):
    return classify_points(spark.createDataFrame([("a", "1#站1#冷机流量"), ("b", "1#站2#冷机流量")], "point_code string, point_name string"))


def _hours(fact):
    return fact.groupBy("station_id", "equipment_id", F.date_trunc("hour", "event_time").alias("stat_hour"), F.to_date("event_time").alias("dt")).agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("n"))


ROWS = [(0, "a", "2024-01-01T00:10:00Z", 1.0), (1, "b", "2024-01-01T00:20:00Z", 2.0), (2, "a", "2024-01-01T01:10:00Z", 3.0)]
LATE = [(2, "a", "2024-01-01T01:10:00Z", 3.0), (3, "a", "2024-01-01T00:40:00Z", 5.0)]


def test_ingest_then_micro_batches_match_batch(spark, tmp_path):
    source, bronze = tmp_path / "in", f"{tmp_path}/bronze"
    _envelopes(source, "1.json", ROWS)
    microbatch.ingest(spark, str(source), bronze, f"{tmp_path}/c1").awaitTermination()
    _envelopes(source, "2.json", LATE)  # one row again, one late row
    microbatch.ingest(spark, str(source), bronze, f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(bronze).count() == 5

    messages = spark.readStream.schema(spark.read.parquet(bronze).schema).option("maxFilesPerTrigger", 1).parquet(bronze)
    points, fact, hours = _points(spark), f"{tmp_path}/fact", f"{tmp_path}/hours"
    for check in ("c2", "c3"):  # the second run replays everything
        microbatch.micro_batches(spark, messages, points, fact, hours, f"{tmp_path}/{check}", _hours, silver.stream_fact, log_path=f"{tmp_path}/log").awaitTermination()
    assert spark.read.parquet(fact).count() == 4
    expected = _hours(silver.stream_fact(readers.decode(readers.batch_envelopes(spark, str(source))).dropDuplicates(["source_topic", "offset_id"]), points))
    get = lambda df: sorted((r["equipment_id"], str(r["stat_hour"]), r["avg_value"], r["n"]) for r in df.collect())
    assert get(spark.read.parquet(hours)) == get(expected)
    assert spark.read.parquet(f"{tmp_path}/log").agg(F.sum("processed_rows")).first()[0] == 10


def test_hourly_stream_with_watermark(spark, tmp_path):
    source = tmp_path / "in"
    _envelopes(source, "1.json", ROWS)
    stream = readers.decode(readers.stream_envelopes(spark, str(source))).withColumn("event_time", F.try_to_timestamp("timestamp"))
    hours = microbatch.hourly_stream(stream, ["sensor_id"], "value", unique=["source_topic", "offset_id"])
    query = hours.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    query = microbatch.hourly_stream(stream, ["sensor_id"], "value").writeStream.format("memory").queryName("hours_all").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["sensor_id"], r["record_count"]) for r in spark.table("hours_all").collect()) == [("a", 1), ("a", 1), ("b", 1)]


def test_marks_and_late_hours(spark):
    df = spark.createDataFrame([(1, "s"), (5, "s")], "t int, station_id string")
    assert microbatch.incremental_since(df, "t", 1).count() == 1 and microbatch.incremental_since(df, "t", None).count() == 2
    batch = spark.sql("SELECT 's' AS station_id, TIMESTAMP '2024-01-01 10:30:00' AS event_time")
    hours = microbatch.affected_hours(batch, ["station_id"])
    assert sorted(r["stat_hour"].hour for r in hours.collect()) == [10, 11]
    assert sorted(r["stat_hour"].hour for r in microbatch.needed_hours(hours).collect()) == [9, 10, 11]
