"""Change propagation: what new readings change, from the fact to minutes, hours and the day, week and month reports.

Each table is built from the one before by grain: (station, minute), (station, hour), (station, period). The grains that a batch touches are
turned into the next table's; a grain is built anew from all rows it needs and replaces its old rows. Partitions are named by
literals: a step reads and writes the days (weeks, months) of its grains, whatever the size of the table.

A meter's advance belongs to two hours with readings, however far apart. So the hours touched are those of the batch and, for meters, the
next hour of the same point that has readings; and an hour is built from its own readings and each meter's last hour before it. Both are looked
for day by day outwards, in growing steps, and only for the points that need it.

The result is what a full rebuild gives. Steps can be repeated: after a stop, the same batch again leads to the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.operators import merge
from meterflow.operators.upsert import exists, matching
from meterflow.plans import hourly, reports, silver
from meterflow.sources.sinks import Lake
from meterflow.streaming import microbatch
from meterflow.streaming.ledger import Ledger

#: Partition columns of the tables.
PARTITIONS = {"fact": "dt", "minutes": "dt", "hours": "dt", "day": "stat_date", "week": "week_start_date", "month": "stat_month"}


def system_hours(minutes: DataFrame, fact: DataFrame) -> DataFrame:
    return hourly.system_hours(hourly.supply_curve(minutes), fact)


def is_meter() -> Column:
    """Points whose hours are advances of a growing reading."""
    code = F.col("point_code")
    return code.isin(*hourly.BOILER_GAS, *hourly.CCHP_METERS.values(), hourly.GENERATOR_GAS) | code.rlike(hourly.GENERATOR_METER)


@dataclass(frozen=True)
class Chain:
    """The tables of a lake and how each is built from the one before."""

    spark: SparkSession
    lake: Lake
    prices: DataFrame | None = None
    minutes: Callable[[DataFrame], DataFrame] = silver.minute_status
    hours: Callable[[DataFrame, DataFrame], DataFrame] = system_hours
    meters: Callable[[], Column] = is_meter
    periods: Sequence[str] = field(default=("day", "week", "month"))

    def staging(self, table: str) -> str:
        return f"{self.lake.path(table)}_staging"

    def kept(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        """A table between steps, written so that it is worked out once; with the mode append beside the rows of that name."""
        path = f"{self.staging('chain')}/{name}"
        df.write.mode(mode).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def days(self, table: str) -> list[date]:
        """The days that a table has, from its directories."""
        if not exists(self.spark, self.lake.path(table)):
            return []
        rows = merge.Stored(self.spark, self.lake.path(table), [PARTITIONS[table]], self.spark.range(0))
        return sorted(date.fromisoformat(v[0]) for v, _ in rows.listed() if v[0])

    def read(self, table: str, days: Sequence[date]) -> DataFrame:
        """A table's rows of some days: the days are literals, so that Spark reads no other partition."""
        return self.lake.read(self.spark, table).filter(F.col("dt").isin(*sorted(days)) if days else F.lit(False))

    def add(self, facts: DataFrame) -> None:
        """Add readings to the fact and bring every table up to date; readings that are there already change nothing."""
        self.propagate(microbatch.upsert_lineage(self.spark, facts, self.lake.path("fact"), self.staging("fact")))

    def rebuild(self) -> None:
        """Every table from the whole fact."""
        fact = self.lake.read(self.spark, "fact")
        self.propagate(fact)

    def propagate(self, facts: DataFrame) -> None:
        """Rebuild what these readings, which the fact has by now, touch."""
        minute = F.date_trunc("minute", "event_time").alias("stat_minute")
        touched = facts.filter(F.col("station_id").isNotNull()).select("station_id", "point_code", minute, F.to_date("event_time").alias("dt")).distinct()
        self._propagate(self.kept(touched, "touched"))

    def propagate_interval(self, start: datetime, end: datetime) -> None:
        """The fallback without a batch's details: rebuild what any reading within the whole hours of an interval touches."""
        low, high = self.spark.range(1).select(*microbatch.window_bounds(F.lit(start), F.lit(end), "hour")).first()
        days = [d for d in self.days("fact") if low.date() <= d <= high.date()]
        self.propagate(self.read("fact", days).filter((F.col("event_time") >= F.lit(low)) & (F.col("event_time") < F.lit(high))))

    def _propagate(self, touched: DataFrame) -> None:
        days = _days(touched)
        if not days:
            return
        self._minutes(touched, days)
        known = MeterHours(self, self.kept(touched.select("station_id").distinct(), "stations"))
        hours = self.kept(self._touched_hours(touched, days, known), "touched_hours")
        days = _days(hours)
        self._hours(hours, days, known)
        for period in self.periods:
            self._report(period, hours, days)

    def _minutes(self, touched: DataFrame, days: list[date]) -> None:
        grains = touched.select("station_id", "stat_minute", "dt").distinct()
        facts = self.read("fact", days).drop(*microbatch.PLACE).withColumn("stat_minute", F.date_trunc("minute", "event_time"))
        made = self.minutes(self.kept(matching(facts, grains, ["station_id", "stat_minute"]).drop("stat_minute"), "minutes_facts"))
        merge.replace_grains_into(self.spark, self.lake.path("minutes"), made, grains, ("dt",), self.staging("minutes"))

    def _touched_hours(self, touched: DataFrame, days: list[date], known: MeterHours) -> DataFrame:
        """(station_id, stat_hour, dt): the batch's hours and each touched meter's next one."""
        own = touched.select("station_id", "point_code", F.date_trunc("hour", "stat_minute").alias("stat_hour"), "dt").distinct()
        following = self._nearest(own.filter(self.meters()), days, known, ahead=True)
        rows = own.select("station_id", "stat_hour").unionByName(following.select("station_id", "stat_hour"))
        return rows.distinct().withColumn("dt", F.to_date("stat_hour"))

    def _nearest(self, asked: DataFrame, days: list[date], known: MeterHours, ahead: bool) -> DataFrame:
        """(station_id, point_code, stat_hour): of each asked hour of a point the next (or the last) other hour with readings."""
        every, rest, found = known.every, asked, []
        low, high, turn = 0, 1, 1 if ahead else -1
        at = {d: i for i, d in enumerate(every)}
        while True:
            reach = [(d, [every[at[d] + turn * k] for k in range(low, high + 1) if 0 <= at[d] + turn * k < len(every)]) for d in days if d in at]
            reach = [(d, own) for d, own in reach if own]
            if not reach:
                break
            last = self.spark.createDataFrame(pa.table({"dt": [d for d, _ in reach], "until": [own[-1] for _, own in reach]}))
            there = known.of({x for _, own in reach for x in own}).drop("dt")
            there = matching(there, rest.select("station_id", "point_code").distinct(), ["station_id", "point_code"])
            rows = there.withColumns({"real": F.lit(True), "dt": F.lit(None).cast("date")}).unionByName(rest.select("station_id", "point_code", "stat_hour", F.lit(False).alias("real"), "dt"))
            span = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
            near = Window.partitionBy("station_id", "point_code").orderBy(F.unix_timestamp("stat_hour")).rangeBetween(*span)
            pick = (F.min if ahead else F.max)(F.when(F.col("real"), F.col("stat_hour"))).over(near)
            rows = rows.withColumn("near", pick).filter("NOT real").join(F.broadcast(last), "dt")  # a row for each touched day
            inside = F.to_date("near") <= F.col("until") if ahead else F.to_date("near") >= F.col("until")
            rows = self.kept(rows.withColumn("known", F.coalesce(inside, F.lit(False))), f"near_{'next' if ahead else 'last'}_{low}")
            found.append(rows.filter("known").select("station_id", "point_code", F.col("near").alias("stat_hour")))
            rest = rows.filter("NOT known").select("station_id", "point_code", "stat_hour", "dt")
            low, high = high + 1, 2 * high + 1
            days = _days(rest)
        out = asked.select("station_id", "point_code", "stat_hour").limit(0)
        for df in found:
            out = out.unionByName(df)
        return out.distinct()

    def _hours(self, hours: DataFrame, days: list[date], known: MeterHours) -> None:
        asked = matching(known.of(days), hours, ["station_id", "stat_hour"])
        before = self._nearest(self.kept(asked, "asked"), days, known, ahead=False)
        before = self.kept(matching(before, hours, ["station_id", "stat_hour"], "left_anti").withColumn("dt", F.to_date("stat_hour")), "before")
        facts = lambda days: self.read("fact", days).drop(*microbatch.PLACE).withColumn("stat_hour", F.date_trunc("hour", "event_time"))
        self.kept(matching(facts(days), hours, ["station_id", "stat_hour"]).drop("stat_hour"), "needed_facts")  # every system's hours read it several times
        facts = self.kept(matching(facts(_days(before)), before, ["station_id", "point_code", "stat_hour"]).drop("stat_hour"), "needed_facts", "append")
        minutes = self.read("minutes", days).withColumn("stat_hour", F.date_trunc("hour", "stat_minute"))
        minutes = self.kept(matching(minutes, hours, ["station_id", "stat_hour"]).drop("stat_hour"), "needed_minutes")
        made = matching(self.hours(minutes, facts), hours, ["station_id", "stat_hour"])
        merge.replace_grains_into(self.spark, self.lake.path("hours"), made, hours, ("dt",), self.staging("hours"))

    def _report(self, period: str, hours: DataFrame, days: list[date]) -> None:
        named, names = reports.add_period(hours, period)
        grains = self.kept(named.select("station_id", *names).distinct(), f"touched_{period}")
        rows, _ = reports.add_period(self.read("hours", sorted({x for d in days for x in period_days(d, period)})), period)
        rows = matching(rows, grains, ["station_id", *names]).drop(*names, "expected_hours")
        made = reports.system_report(rows, period, self.prices)
        merge.replace_grains_into(self.spark, self.lake.path(period), made, grains, (PARTITIONS[period],), self.staging(period))


class MeterHours:
    """(station_id, point_code, stat_hour, dt) of the meters of some stations, as long as the fact doesn't change: a day is looked up once."""

    def __init__(self, chain: Chain, stations: DataFrame):
        self.chain, self.stations, self.every, self.had = chain, stations, chain.days("fact"), set()
        self.rows: DataFrame | None = None

    def of(self, days: Iterable[date]) -> DataFrame:
        days = sorted(set(days))
        if self.rows is None or not self.had.issuperset(days):
            facts = self.chain.read("fact", [d for d in days if d not in self.had]).filter(self.chain.meters())
            rows = matching(facts, self.stations, ["station_id"]).select("station_id", "point_code", F.date_trunc("hour", "event_time").alias("stat_hour"), "dt").distinct()
            self.rows = self.chain.kept(rows, "meter_hours", "append" if self.had else "overwrite")
            self.had.update(days)
        return self.rows.filter(F.col("dt").isin(*days) if days else F.lit(False))


def propagating_stream(messages: DataFrame, points: DataFrame, chain: Chain, ledger: Ledger, checkpoint: str, fact_of: Callable[[DataFrame, DataFrame], DataFrame] = silver.stream_fact):
    """A query that brings each micro-batch through the chain and enters it in the ledger. Killed before the entry, it takes the batch
    again, which changes nothing that is there; an entered batch is not taken twice."""

    def each(batch: DataFrame, number: int) -> None:
        def work() -> int:
            facts = fact_of(batch, points).persist()
            chain.add(facts)
            rows = facts.count()
            facts.unpersist()
            return rows

        ledger.once(number, work)

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def period_days(day: date, period: str) -> list[date]:
    """All days of the day's, week's (from Monday) or month's period."""
    if period == "day":
        return [day]
    if period == "week":
        monday = day - timedelta(days=day.weekday())
        return [monday + timedelta(days=i) for i in range(7)]
    first = day.replace(day=1)
    after = (first + timedelta(days=32)).replace(day=1)
    return [first + timedelta(days=i) for i in range((after - first).days)]


def _days(rows: DataFrame) -> list[date]:
    """The distinct days of a small table."""
    return sorted(r[0] for r in rows.select("dt").distinct().collect())
