"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the data (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import re
import time

from barriometrics.plans.catalog import QUERIES
from barriometrics.session import build_session

HEADLINE = (
    "extract_cards_z", "dedup_by_code", "features_regex_z", "map_neighborhood", "iqr_outlier_filter",
    "iqr_price_then_area", "training_table", "kpi_report_from_raw", "kpi_report", "snapshot_set_diff",
    "avg_price_by_rooms", "area_distribution", "price_box_stats", "historic_price_series", "best_deals",
    "price_per_m2_trend", "trend_rows", "places_within_radius", "report_request", "deviation_bins", "train_simple",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # JVM and file cache, not timed
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
