"""Time the headline queries end to end and print one JSON line.

Every query is written to a ``noop`` sink, so all rows and columns are computed
and nothing is gathered. ``BENCH_ALL=1`` times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from aisle import plans
from aisle.session import local_session

HEADLINE = [
    "kpi_summary", "store_ranking", "missing_periods", "report_sales_summary", "iqr_anomalies", "yoy_anomalies",
    "rfm_scores", "sales_forecast", "weather_adjusted_forecast", "backtest", "tune_weights",
    "channel_kpis", "attribution_time_decay", "attribution_last_touch", "channel_funnel", "member_journey",
    "member_lifecycle", "evaluate_campaigns", "lifecycle_stage", "supplier_scorecard", "stockout_analysis",
    "order_quantities", "employee_scores", "evaluate_sites", "zone_facts", "layout_advice",
    "energy_cost_advice", "schedule_advice", "container_state", "cumulative_kwh", "trend_buffer",
    "clean_sales_feed", "quality_scores", "frequent_pairs", "association_rules", "layout_clusters",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = plans.queries()
    names = list(registered) if os.environ.get("BENCH_ALL") else HEADLINE
    if os.environ.get("BENCH_ONLY"):
        names = [n for n in registered if n in os.environ["BENCH_ONLY"].split(",")]
    # One small job first: JVM start and class loading are not the queries' time.
    registered["container_state"](spark, directory).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{name:32} {seconds[name]:8.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
