"""Hourly advances of meters as a stream: each meter's open hours and its last reading are state, and no earlier row is read again.

An hour of a meter is open while the watermark has not passed its end: its greatest reading so far is kept, and a timer is set to its end. When the
timer fires the hour is closed: its advance is against the last closed hour that has a row, however long ago that was, by the rules of
``windows.counter_delta`` (NULL on a reset, a jump beyond the most, a missing reading, or the first hour). State is one closed reading and the open hours of
each meter, so it grows with the number of meters and the lateness, not with time.

A row within the lateness lands in its open hour, so the stream's rows are those of the batch; one that comes after its hour is closed is
left out, as it is by Spark's watermark; ``microbatch`` or ``propagate`` take such rows in. Needs the RocksDB state store
(``STATE_STORE``). Rows with a NULL time have no hour and go.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Setting and value that the query's session needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HOUR_MS = 3_600_000


class Advances(StatefulProcessor):
    def __init__(self, keys: Sequence[str], most: float):
        self.keys, self.most = list(keys), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "hour bigint", "reading double")
        self.last = handle.getValueState("last", "hour bigint, reading double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        closed = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            for hour, reading in part.groupby("hour")["value"].max().items():  # an hour without values has NaN
                if closed is not None and hour <= closed:
                    continue
                known = self.open.getValue((int(hour),))[0] if self.open.containsKey((int(hour),)) else None
                if not self.open.containsKey((int(hour),)):
                    self.handle.registerTimer((int(hour) + 1) * HOUR_MS)
                values = [x for x in (known, None if pd.isna(reading) else float(reading)) if x is not None]
                self.open.updateValue((int(hour),), (max(values, default=None),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() // HOUR_MS
        out = []
        for hour in sorted(k[0] for k in self.open.keys() if k[0] < end):
            reading = self.open.getValue((hour,))[0]
            before = self.last.get()[1] if self.last.exists() else None
            delta = None if reading is None or before is None or not 0 <= reading - before <= self.most else reading - before
            out.append((*key, hour, reading, delta))
            self.last.update((hour, reading))
            self.open.removeKey((hour,))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "hour", "reading", "delta"]).astype({"reading": float, "delta": float})


def meter_advances(readings: DataFrame, keys: Sequence[str], ts: str, value: str, most: float, lateness: str = "2 hours") -> DataFrame:
    """(keys, stat_hour, reading, delta) of each hour once it is closed, from a stream of readings."""
    hour = F.floor(F.unix_timestamp(ts) / 3600).cast("bigint")
    rows = readings.filter(F.col(ts).isNotNull()).withWatermark(ts, lateness).select(*keys, ts, hour.alias("hour"), F.col(value).cast("double").alias("value"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", hour bigint, reading double, delta double"
    made = rows.groupBy(*keys).transformWithStateInPandas(Advances(keys, most), schema, "Append", "EventTime")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)  # noqa: E731  pandas has no other NULL in a column of floats
    return made.select(*keys, F.timestamp_seconds(F.col("hour") * 3600).alias("stat_hour"), known("reading"), known("delta"))
