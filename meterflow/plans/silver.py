"""Silver tables: the standardised fact and the minute status table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions import metrics
from meterflow.functions.scalars import as_ts
from meterflow.operators import aggregates, joins, windows

#: Fixed value: the word in the names of hour meters.
HOUR_METER = "运行时间"
POINT_COLUMNS = ["point_name", "station_id", "system_type", "equipment_id", "theme", "unit", "measure_role"]


def with_points(readings: DataFrame, points: DataFrame) -> DataFrame:
    """Readings that have a time, with their point's attributes or NULLs."""
    fact = joins.enrich(readings.withColumnRenamed("sensor_id", "point_code"), points, "point_code", "point_code", POINT_COLUMNS)
    return fact.withColumn("event_time", as_ts("timestamp")).filter(F.col("event_time").isNotNull())


def point_fact(readings: DataFrame, points: DataFrame, mode: str = "last_row") -> DataFrame:
    """Readings with their point's attributes, gaps filled and flagged. Readings without a time go; those whose point nobody
    knows stay, without attributes, for the audits that count them."""
    filled = windows.fill_gaps(with_points(readings, points), ["point_code"], "event_time", "value", "theme", mode=mode)
    flagged = filled.withColumn("quality_flag", windows.quality_flag("value", "theme", "gap_s"))
    return flagged.withColumns({"value": F.col("filled"), "dt": F.to_date("event_time")}).drop("filled", "gap_s", "timestamp")


def stream_fact(readings: DataFrame, points: DataFrame) -> DataFrame:
    """The fact of a micro-batch: nothing is filled, missing values are flagged; readings of unknown points stay here too."""
    fact = with_points(readings, points)
    return fact.withColumns({"quality_flag": F.when(F.col("value").isNull(), "missing").otherwise("normal"), "dt": F.to_date("event_time")}).drop("timestamp")


def status_columns() -> dict[str, Column]:
    """Which readings make each column. A status point named as an hour meter counts hours, every other one tells whether the unit runs."""
    role, theme = F.col("measure_role"), F.col("theme")
    meter = F.col("point_name").contains(HOUR_METER)
    by_role = {name: role == name for name in ("supply_temp", "return_temp", "pressure", "flow", "power")}
    return by_role | {"runtime_hours": (theme == "status") & meter, "start_count": theme == "count", "run_flag": (theme == "status") & ~meter}


def minute_status(fact: DataFrame, system: str = "chiller", header: str = "chiller_header") -> DataFrame:
    """A row for each unit and minute; the header's pressure fills in, missing power is estimated."""
    of = fact.filter(F.col("system_type") == system).withColumn("stat_minute", F.date_trunc("minute", "event_time"))
    keys = ["station_id", "stat_minute", "dt"]
    wide = aggregates.conditional_pivot(of, ["station_id", "equipment_id", "stat_minute", "dt"], "value", status_columns())
    units, head = wide.filter(F.col("equipment_id") != header), wide.filter(F.col("equipment_id") == header)
    filled = joins.fill_from_header(units, head, keys, "pressure")
    return filled.withColumn("power", metrics.power_or_estimate("power", "run_flag", "flow", "supply_temp", "return_temp"))
