"""Sources: message envelopes, histories, prices, change logs and point dictionaries, each as one declarative read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.functions.scalars import as_ts
from meterflow.sources import schemas


def kafka_options(servers: str, pattern: str = "sensor_.*", starting: str = "latest", most: int | None = 15_000, ending: str | None = None) -> dict[str, str]:
    """Options of a Kafka read: all topics of a pattern, from where, how many records a trigger takes at most; lost data is no error.

    With ending the read is bounded, and takes no cap.
    """
    if starting not in ("earliest", "latest"):
        raise ValueError("starting is earliest or latest")
    out = {"kafka.bootstrap.servers": servers, "subscribePattern": pattern, "startingOffsets": starting, "failOnDataLoss": "false"}
    if ending:
        return out | {"endingOffsets": ending}
    return out | ({"maxOffsetsPerTrigger": str(most)} if most else {})


def stream_envelopes(spark: SparkSession, path: str | None = None, fmt: str = "json", max_files: int | None = None, **options) -> DataFrame:
    """A stream of message envelopes: from Kafka (fmt="kafka" with ``kafka_options``), or from files of the same columns."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        return reader.options(**options).load()
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema(schemas.ENVELOPE).options(**options).load(path)


def batch_envelopes(spark: SparkSession, path: str | None = None, fmt: str = "json", **options) -> DataFrame:
    """The same as a bounded read; from Kafka between its starting and ending offsets."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load() if fmt == "kafka" else reader.schema(schemas.ENVELOPE).load(path)


def decode(envelopes: DataFrame, topic_prefix: str = "sensor_", sensor_from: str = "payload") -> DataFrame:
    """Messages with their lineage. The sensor id is the payload's, else the key, else the topic without its prefix.

    ``sensor_from="topic"`` prefers the topic. Malformed JSON gives NULL fields, never an error.
    """
    data = F.from_json(F.col("value").cast("string"), schemas.MESSAGE)
    topic = F.regexp_replace("topic", f"^{topic_prefix}", "")
    order = ["d.sensor_id", F.col("key").cast("string"), topic] if sensor_from == "payload" else [topic, "d.sensor_id", F.col("key").cast("string")]
    out = envelopes.withColumn("d", data).select(
        F.col("d.timestamp").alias("timestamp"), F.col("d.value").alias("value"), F.coalesce(*order).alias("sensor_id"), F.col("d.label").alias("label"),
        F.col("topic").alias("source_topic"), F.col("partition").alias("partition_id"), F.col("offset").alias("offset_id"), F.col("d.is_simulated").alias("is_simulated"),
        as_ts("d.push_time").alias("push_time"), F.current_timestamp().alias("ingest_time"),
    )
    return out.withColumn("dt", F.coalesce(F.to_date(as_ts("timestamp")), F.to_date("ingest_time")))


def history(spark: SparkSession, path: str) -> DataFrame:
    """A folder of headerless tab-separated files, one for each sensor, which its file's name tells."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return spark.read.schema(schemas.HISTORY).csv(path, sep="\t").select("timestamp", "value", name.alias("sensor_id"))


def price_snapshot(spark: SparkSession, path: str, source: str = "snapshot") -> DataFrame:
    """Landed price records with the price as number (NULL where it is none)."""
    return with_price(spark.read.schema(schemas.PRICE).json(path), source)


def with_price(df: DataFrame, source: str) -> DataFrame:
    out = df.withColumns({"price": F.col("price").try_cast("double"), "source": F.lit(source), "ingest_time": F.current_timestamp()})
    return out.withColumn("dt", F.to_date("ingest_time"))


def change_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHANGE_LOG).json(path)


def flatten_changes(log: DataFrame, schema: str = "energy_prices", table: str = "prices", kinds: tuple = ("Write", "Update")) -> DataFrame:
    """A row for each changed row of the table's write and update events, with an event id; after-values come before values."""
    kept = log.filter((F.col("schema") == schema) & (F.col("table") == table) & F.lower("type").rlike("|".join(k.lower() for k in kinds)))
    each = kept.select("log_file", "log_pos", "timestamp", "type", F.posexplode("rows").alias("n", "r"))
    v = each.select("*", F.coalesce("r.after_values", "r.values").alias("v")).filter(F.col("v").isNotNull())
    named = {n: F.col(f"v.UNKNOWN_COL{i}") for i, n in enumerate(schemas.CDC_COLUMNS)}
    named |= {"id": named["id"].try_cast("bigint"), "price": named["price"].try_cast("double")}
    return v.select(F.concat_ws(":", "log_file", "log_pos", "n").alias("event_id"), F.timestamp_seconds("timestamp").alias("event_time"), *[c.alias(n) for n, c in named.items()])


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Point codes and labels from triple text files."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    return extract_points(text, "value", ["file"])


def extract_points(df: DataFrame, text: str, order: list[str], pattern: str = r'<([^>]*)>\s+rdf:type\s+sosa:FeatureOfInterest\s*;\s*rdfs:label\s+"([^"]*)"@zh') -> DataFrame:
    """(point_code, point_name, labels): the first label of each code by order and place in the text, and how many different ones it has."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("code"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("label"))
    rows = df.select(*order, F.posexplode(found).alias("n", "p")).select(*order, "n", F.col("p.code").alias("point_code"), F.col("p.label").alias("point_name"))
    place: Column = F.struct(*order, "n")
    return rows.groupBy("point_code").agg(F.min_by("point_name", place).alias("point_name"), F.countDistinct("point_name").alias("labels"))


def latest_prices(prices: DataFrame, keys: tuple = ("station_code", "price_type"), updated: str = "updated_at") -> DataFrame:
    """The price dimension: for each key and effective date the version updated last."""
    ts = as_ts(updated)
    dated = prices.withColumns({"data_updated_at": ts, "effective_date": F.to_date(ts)})
    order = Window.partitionBy(*keys, "effective_date").orderBy(F.desc("data_updated_at"), F.desc("id"))
    out = dated.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
    return out.withColumn("price_year_month", F.date_format("effective_date", "yyyy-MM"))
