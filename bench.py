"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "a1_channel_summary",
    "a17_trial_quality",
    "a33_robust_raw_summary",
    "j7_window_sample_join",
    "j8_lag_one_interval",
    "m5_fold_probability_metrics",
    "m6_scope_summary",
    "x3_repeated_outer_splits",
    "i3_bootstrap_intervals",
    "r4_residual_representation",
    "l7_nested_elastic_net",
    "flow_lagged_signal_increment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from cohortlift.plans.catalog import QUERIES
    from cohortlift.session import local_session

    spark = local_session(cores, shuffle_partitions=cores)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps({
            "metric": "headline_total",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(sf_dir.rstrip("/")),
        })
    )


if __name__ == "__main__":
    main()
