"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of Parquet tables, BENCH_CPUS the local cores. Each query is
run once into a sink that reads every row, after one small warm-up query. The forest has
the job's 512 trees.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotweave.plans.registry import QUERIES  # noqa: E402
from slotweave.session import local_session  # noqa: E402

HEADLINE = [
    "event_clock",
    "hourly_rollup",
    "hourly_panel",
    "modelling_panel",
    "lag_last_week",
    "rate_before_now_daily",
    "rate_latest_only_weekly",
    "rolling7_device",
    "rolling7_fleet",
    "previous_day_rates",
    "model_features",
    "model_features_windows",
    "model_features_compat",
    "split_rows",
    "holdout_rows",
    "roc_points_by_device",
    "auc_by_device",
    "auc_pooled",
    "confusion_by_device",
    "csv_roundtrip",
    "forecast_predict",
    "forest_predict",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    QUERIES["hourly_panel"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    report = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder).removeprefix("sf"),
    }
    print(json.dumps(report), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
