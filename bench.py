"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from plumbline.session import local_session
from plumbline.workload.registry import queries

HEADLINE = [
    "reconcile_orders", "reconcile_metrics", "reconcile_tolerance", "reconcile_text_vs_typed",
    "reconcile_composite_key", "rule_packed", "rule_amount_range", "rule_unknown_policy",
    "rule_ratio_derivation", "map_customer", "map_policy", "map_claim", "linked_claims",
    "orphan_claims", "claim_outside_coverage", "customer_360", "customer_360_reconcile",
    "staging_vs_curated_policy", "staging_vs_curated_claim", "upsert_scd1", "update_from",
    "watermark_transition", "latest_version", "historical_claims", "record_counts",
    "preload_counts", "profile_orders", "profile_lineitem", "latest_execution",
    "dashboard_summary", "pass_rate_per_day", "required_params",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    known, times = queries(), {}
    for name in chosen:
        taken = []
        for _ in range(runs + 1):  # the first run warms up
            began = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
