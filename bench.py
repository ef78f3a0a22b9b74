"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the table directory, BENCH_CPUS the local cores, BENCH_QUERIES an optional comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.catalog import REGISTRY, Views  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402

HEADLINE = (
    "stage_transactions",
    "stage_wallets",
    "fact_transactions",
    "extract_wallets",
    "dim_wallet",
    "dim_wallet_summary",
    "agg_daily_metrics",
    "upsert_if_newer",
    "dash_totals",
    "dash_daily_volume",
    "dashboard_summary",
    "connected_to_suspicious",
    "wallet_stats",
    "wallet_counterparties",
    "basic_features",
    "behavioral_features",
    "temporal_features",
    "all_features",
    "value_percentiles",
    "profile_overview",
    "quality_report",
    "knn_join",
    "lof",
    "isolation_forest_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # read the files once before timing
    Views(spark, sf_dir).raw_transactions.write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.time()
        REGISTRY[name].build(Views(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
