"""
sales, sales of the last 30 days, and the scoreboards.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and prints ONE
JSON line. Each query is built fresh from the source tables every run (no caching of
results); the first run per query is reported as ``cold`` (JVM + codegen warm-up), the
headline ``value`` is the sum of warm medians of 3 runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpiloom.plans.catalog import QUERIES  # noqa: E402
from kpiloom.session import local_session  # noqa: E402

HEADLINE = [
    # BASELINE rows: OKR cards, monthly grain
    "okr_sales_monthly", "okr_orders_monthly", "okr_package_share_monthly", "okr_single_share_monthly",
    "okr_aov_monthly", "okr_completed_monthly", "okr_new_companies_monthly", "okr_leads_monthly",
    "okr_per_washer_per_day_monthly", "okr_completed_from_packages_monthly", "okr_csat_monthly",
    "okr_complaint_resolution_hours_monthly", "okr_complaints_monthly",
    # M01 daily growth sales, M25 last 30 days
    "growth_sales_daily", "sales_last_n_days",
    # scoreboards and other multi-component reports
    "okr_scoreboard_daily", "okr_scoreboard_weekly", "okr_scoreboard_weekly_matrix", "experiment_daily",
    "growth_repeat_cumulative", "growth_aopu_cumulative", "growth_washes_per_order_monthly",
    "indiv_new_vs_returning", "orders_by_area",
]


# hardware and data size not stated) for the reports that have one.
BASELINE_MS = {
    "okr_sales_monthly": 3183, "okr_orders_monthly": 1946, "okr_package_share_monthly": 2075,
    "okr_single_share_monthly": 3027, "okr_aov_monthly": 3036, "okr_completed_monthly": 2217,
    "okr_new_companies_monthly": 803.5, "okr_leads_monthly": 1094, "okr_per_washer_per_day_monthly": 715,
    "okr_completed_from_packages_monthly": 836, "okr_csat_monthly": 539.5,
    "okr_complaint_resolution_hours_monthly": 437, "okr_complaints_monthly": 803,
    "growth_sales_daily": 1128.25, "sales_last_n_days": 378,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    cold, warm, rows = {}, {}, {}
    for name in names:
        q = QUERIES[name]
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            out = q.run(spark, sf_dir).collect()
            dt_ = time.perf_counter() - t0
            if i == 0:
                cold[name] = round(dt_, 3)
            else:
                times.append(dt_)
        warm[name] = round(statistics.median(times), 3)
        rows[name] = len(out)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    with_base = [n for n in warm if n in BASELINE_MS]
    vs = {n: round(BASELINE_MS[n] / 1000 / warm[n], 2) for n in with_base}
    print(json.dumps({
        "metric": "headline_reports_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "rows": rows, "sf": sf, "cpus": cpus,
        "cold_total": round(sum(cold.values()), 3),
        "baseline_sec": {n: BASELINE_MS[n] / 1000 for n in with_base},
        "baseline_total_sec": round(sum(BASELINE_MS[n] for n in with_base) / 1000, 3),
        "ours_on_baseline_total_sec": round(sum(warm[n] for n in with_base), 3),
        "speedup_vs_baseline": vs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
