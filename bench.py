"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from runlens.plans.catalog import QUERIES
from runlens.session import tune

HEADLINES = (
    "run_summary", "metrics_overall", "metrics_by_day", "metrics_by_project", "query_runs", "trend_month", "trend_run", "trend_summary", "trend_warnings",
    "failure_groups", "failure_distribution", "impacted_suites", "failure_insights", "root_cause_clusters",
    "lifecycle_records", "capture_coverage", "api_activity", "slowest_tests", "trace_lookup", "manifest_audit", "history_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = str(int(cpus)) if cpus.isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    # Warm-up: starts the code paths that every query shares, so that the first one timed is not charged for them.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    QUERIES["metrics_by_month"](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    wanted = [n for n in HEADLINES if n in sys.argv[1:] or len(sys.argv) == 1]
    times = {}
    for name in wanted:
        begin = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
