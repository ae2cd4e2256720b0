"""A ledger of what incremental jobs have done, so that a job that was stopped goes on without loss or repeat.

A batch is entered before it starts, with the interval of ingest times that it takes, and again when all its tables are written. A
batch that was begun and not ended is taken again with the very same interval, whatever has arrived meanwhile; one that has ended is
not taken twice. The work itself must give the same tables when it is repeated, as the merges by key and the rebuilt grains do.
Entries are appended, a small file each; a file shows only when it is whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators.upsert import exists

ENTRY = "job string, batch bigint, state string, since timestamp, until timestamp, processed_rows bigint, entered_at timestamp"
BEGUN, DONE = "begun", "done"


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    path: str
    job: str

    def entries(self) -> DataFrame:
        rows = self.spark.read.schema(ENTRY).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], ENTRY)
        return rows.filter(F.col("job") == self.job)

    def enter(self, batch: int, state: str, since: datetime | None = None, until: datetime | None = None, rows: int | None = None) -> None:
        row = self.spark.createDataFrame([(self.job, batch, state, since, until, rows, datetime.now())], ENTRY)
        row.coalesce(1).write.mode("append").parquet(self.path)

    def is_done(self, batch: int) -> bool:
        return not self.entries().filter((F.col("batch") == batch) & (F.col("state") == DONE)).isEmpty()

    def last(self):
        """The latest batch's row: batch, since, until, and whether it is done; None before the first."""
        by_batch = self.entries().groupBy("batch").agg(F.max("since").alias("since"), F.max("until").alias("until"), F.bool_or(F.col("state") == DONE).alias("done"))
        return by_batch.orderBy(F.desc("batch")).first()

    def once(self, batch: int, work: Callable[[], int | None]) -> bool:
        """Do a numbered batch unless it is done; whether it was done now. For ``foreachBatch``, whose checkpoint repeats a batch with its rows."""
        if self.is_done(batch):
            return False
        self.enter(batch, DONE, rows=work())
        return True

    def cut_over(self, rows: DataFrame, ingest_time: str = "ingest_time") -> None:
        """Take everything up to now as done, without processing it."""
        until, last = rows.agg(F.max(ingest_time)).first()[0], self.last()
        if until is not None:
            self.enter(last["batch"] + 1 if last else 0, DONE, last["until"] if last else None, until, 0)

    def advance(self, rows: DataFrame, work: Callable[[DataFrame], int | None], ingest_time: str = "ingest_time") -> int | None:
        """Work on the rows that have arrived since the last batch; the batch's number, or None if nothing has. A batch that was begun
        and not ended comes first, with its own interval."""
        last = self.last()
        if last is not None and not last["done"]:
            batch, since, until = last["batch"], last["since"], last["until"]
        else:
            batch, since = (last["batch"] + 1, last["until"]) if last else (0, None)
            until = _after(rows, ingest_time, since).agg(F.max(ingest_time)).first()[0]
            if until is None:
                return None
            self.enter(batch, BEGUN, since, until)
        done = work(_after(rows, ingest_time, since).filter(F.col(ingest_time) <= F.lit(until)))
        self.enter(batch, DONE, since, until, done)
        return batch


def _after(rows: DataFrame, ingest_time: str, since: datetime | None) -> DataFrame:
    return rows if since is None else rows.filter(F.col(ingest_time) > F.lit(since))
