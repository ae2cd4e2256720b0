"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from meterflow import catalog
from meterflow.catalog.base import Tables
from meterflow.catalog.operations import ENTITY, copied
from meterflow.plans import audit

HEADLINES = """
    report_day report_week report_month latest_168_workload lags_and_trailing training_features seasonal_forecast gap_fill_and_flags
    minute_pivot counter_delta proportional_allocation reconcile_orders enrich_facts hours_of_full_days point_fact system_hours
""".split()
#: Rows of the published workloads, and what they do.
PUBLISHED_ROWS = 1_077_680
WORKLOADS = {"workload_report": audit.report_workload, "workload_latest_168": audit.latest_workload, "workload_features": audit.feature_workload}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) if cpus.isdigit() else 8))).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    store = tempfile.mkdtemp(prefix="spark-bench-")
    Tables(spark, folder).hours.write.parquet(f"{store}/hours")
    hours = spark.read.parquet(f"{store}/hours")
    copies = -(-PUBLISHED_ROWS // max(1, hours.count()))

    def run(name: str) -> None:
        if name in WORKLOADS:
            WORKLOADS[name](copied(hours, copies), ENTITY).collect()
        else:
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    names = sys.argv[1:] or [*WORKLOADS, *HEADLINES]
    for name in [n for n in names if n in WORKLOADS] or names[:1]:
        run(name)  # starts the workers and compiles
    took = {}
    for name in names:
        start = time.time()
        run(name)
        took[name] = round(time.time() - start, 3)
    rows = hours.count() * copies
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "workload_rows": rows}))


if __name__ == "__main__":
    main()
