"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
local cores (default 8), BENCH_QUERIES an optional comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from merchantlens import registry  # noqa: E402
from merchantlens.session import local_session  # noqa: E402

HEADLINE = (
    "daily_kpis",
    "platform_trend",
    "daily_status_rates",
    "revenue_by_category",
    "payment_distribution",
    "payment_mix",
    "headline_kpis",
    "period_compare",
    "revenue_series",
    "top_categories",
    "top_merchants_in_category",
    "export_report",
    "top_payment_method",
    "merchant_size_band",
    "orphan_transactions",
    "duplicate_transactions",
    "null_rates",
    "seasonal_index",
    "event_effect",
    "daily_series_category",
    "daily_series_merchant",
    "date_spine",
    "feature_frame",
    "baseline_forecast",
    "baseline_backtest",
    "forecast_overlay",
    "refund_alerts",
    "revenue_anomalies",
    "question_answers",
    "stored_daily",
    "gbt_importance",
    "gbt_forecast",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    shared = tempfile.mkdtemp(prefix="merchantlens-bench-")
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cores=cpus, partitions=partitions, spark__checkpoint__dir=shared)
    queries = registry.queries()

    def run(name: str) -> float:
        begun = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    run("daily_kpis")  # starts the JVM's compilers and the file cache
    seconds = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
