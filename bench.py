"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

What the queries store goes to a folder below $BENCH_WORK_DIR (default: the system's temporary
folder), which is removed at the end. Each query runs once, with nothing kept from another.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from steadycast.plans import catalog
from steadycast.session import local_session

HEADLINE = [
    "persistence_by_split",
    "session_ids",
    "cross_layer_feature_contract",
    "rolling_features",
    "split_summary",
    "binary_metrics",
    "metrics_by_dimension",
    "model_comparison",
    "threshold_sweep",
    "risk_coverage",
    "applied_trust",
    "source_reconciliation",
    "bitrate_profile",
    "global_gap_distribution",
    "imputation_medians",
    "review_sample",
    "explanation_verdicts",
    "stream_features",
    "scenario_files",
    "isotonic_calibration",
    "forecast_model_comparison",
]


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-", dir=os.environ.get("BENCH_WORK_DIR"), ignore_cleanup_errors=True) as work:
        run(work)


def run(work: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"), int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(work)
    names = sys.argv[1:] or HEADLINE
    # One small query first, so that the first timing does not include the start of the JVM.
    catalog.QUERIES["split_order"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
