"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then three times; the median counts. Results go
to Spark's ``noop`` sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from cliplake import plans
from cliplake.session import build_session

HEADLINE = (
    "C1_catalog_latest",
    "C9_interval_overlap",
    "C10_scored_match",
    "C11_lag_correlation",
    "D5_average_speed",
    "D8_project_rollup",
    "D12_dashboard_all",
    "D16_batch_verdict",
    "E2_timeline",
    "E3_sequence_sessions",
    "E6_reorder_sessions",
    "E9_chapters",
    "H9_clean_description",
    "I1_probe_metadata",
    "I4_progress_log",
    "J2_transient_peaks",
    "J6_best_segment",
    "K2_job_events",
    "L2_stability_gate",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [a for a in sys.argv[1:] if not a.startswith("-")] or list(HEADLINE)
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    known = plans.all_queries()
    if names == ["all"]:
        names = list(known)
    took: dict[str, float] = {}
    for name in names:
        runs = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            if i or not repeats:
                runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
