"""Benchmark the headline queries.

Runs each query to completion (``noop`` sink: full execution, no driver
collect) on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and prints one
JSON line.  Every query runs twice: the first pass includes JVM warm-up and
code generation and is reported as ``cold``; ``value`` is the steady-state
(second pass) total.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "insights",
    "category_analysis",
    "month_category_summary",
    "weekly_heatmap",
    "describe_amount",
    "clean_transactions",
    "apply_expense_updates",
    "upsert_budgets",
    "budget_alerts",
    "feature_table_daily",
    "feature_table_daily_gapfilled",
    "trailing_mean_forecast",
    "seasonal_trend_forecast",
    "tfidf_features",
    "recent_transactions",
    "csv_import",
    "keep_frequent_categories",
    "classification_report",
    "boosted_tree_monthly",
    "monthly_recursive_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tallyspark.plans import QUERIES
    from tallyspark.session import build_session, release
    spark = build_session("tallyspark-bench", cores=cpus, shuffle_partitions=max(cpus, 8))
    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 3)

    # first pass: cold (JIT, code generation, file listing); second: steady state
    cold = {name: run(name) for name in HEADLINE}
    warm = {name: run(name) for name in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_warm", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "cold": cold,
                      "cold_total": round(sum(cold.values()), 3), "sf": sf}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
