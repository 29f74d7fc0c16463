"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the
number of local cores (default 8). Every query is run to its last row by a no-op sink,
after one uncounted pass over the smallest tables, when they are there.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cohortspark.plans.catalog import QUERIES
from cohortspark.session import local_session

HEADLINE = (
    "label_quality_by_group", "hourly_bins", "concept_rules", "keep_last_rows", "dense_grid",
    "sliding_windows", "tabular_summary", "normalization_stats", "normalized_rows",
    "mortality_windowed", "aki_labels", "stay_split", "ranking_metrics", "binary_report",
    "calibration_error", "binary_fairness", "price_summary", "bootstrap_accuracy",
    "signed_rank_test", "timestep_budget_mask", "missing_by_group", "embedding_dim_stats",
    "bootstrap_auroc", "bootstrap_binary", "embedding_report", "statistical_tests", "dataset_build",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(os.path.normpath(sf)), "sf0.001")
    if os.path.isdir(warm):  # loads classes and compiles plans on the smallest tables, not counted
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(os.path.normpath(sf)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
