"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the cores. Each query runs once
unmeasured at the same size to load classes and compile code, then ``BENCH_RUNS`` times;
the median counts. Results are written to the ``noop`` sink, so every row is computed and
none passes through the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidelog import registry
from tidelog.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "daily_trend_on_state",
    "b02_unwrap",
    "a09_split_valid",
    "a07_merge_upsert",
    "c02_current_state",
    "c07_collapse_sum",
    "c10_agg_state_merge",
    "d01_ddl_catalog",
    "d05_refine_types",
    "e02_row_counts",
    "e07_sync_category7",
    "e14_checksum_diff",
    "e16_reconcile",
    "f04_classify",
    "f11_root_causes",
    "g04_rates",
    "g09_log_summary",
    "h04_daily_trend",
    "h06_product_performance",
    "h10_revenue_summary",
    "h25_retention_week",
    "h26_funnel",
    "h27_product_revenue",
    "h28_leaderboard",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", CPUS, "tidelog-bench", {"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    times = {}
    for name in HEADLINE:
        run(spark, name)
        times[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
