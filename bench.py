"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from ringwatch.plans import registry  # noqa: E402

HEADLINE = [
    "p6_dedupe_by_time",
    "r5_assess_points",
    "a1_ring_risk_trigger",
    "a2_earliest_warning",
    "j1_fuse",
    "j3_enrich_geo",
    "j6_last_k_rings",
    "a5_risk_history",
    "a9_tbm_profile",
    "a12_score_bounds",
    "a13_robust_scalers",
    "a15_kde_thresholds",
    "w3_rolling_median",
    "w4_sliding_windows",
    "w5_multi_ring_sequences",
    "w8_trend_features",
    "w14_key_parameters",
    "q1_ring_rule_report",
    "q6_parameter_history",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # methods above 8000 bytes are not compiled by the JVM; fall back to split projections
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # the first query would carry the start of the JVM and the session
    queries[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
