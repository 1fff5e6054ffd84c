"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is timed from its own derivations on: intermediate tables shared between queries are dropped first, so no query profits from another. One untimed query
warms the JVM; then the median of BENCH_RUNS runs is taken.
"""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import runtime  # noqa: E402
from tidemark.catalog import all_queries  # noqa: E402

HEADLINE = ["l01_event_outcome", "l01_sixteen_labels", "l02_window_quality", "j01_asof_features", "l12_fingerprint_table", "l13_target_fingerprint", "w04_nearest_level_expansion", "a05_exact_quantiles",
            "j07_history_sums", "w18_recent_analogues", "p04_sufficiency", "x04_cluster_bootstrap", "w14_reliability_bins", "w07_w12_market_structure", "l08_surprise_for_filing", "j15_sponsor_match",
            "s07_html_lines", "l03_item_classification", "k08_session_coverage", "u03_reconcile"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = runtime.local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    queries["l01_event_outcome"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            runtime.forget_shared_tables()
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
