"""Time the headline queries at one scale; prints one JSON line.

Each query is built and its whole result is computed without being collected (`noop` sink).
The best of the runs is reported, so that JVM warm-up does not hide the plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")

from ebbtide.registry import QUERIES
from ebbtide.registry import common
from ebbtide.session import build_session

HEADLINE = [
    "user_dataset",
    "sql_from_file",
    "behavior_counts",
    "engagement_bounds",
    "latest_device",
    "first_day_events",
    "param_value_counts",
    "profile_table",
    "pairwise_stats",
    "boxplot_stats",
    "stratified_split",
    "count_vectorize_multi",
    "most_common_categories",
    "fit_transform_stages",
    "roc_points",
    "precision_recall_by_threshold",
    "metric_panel",
    "evaluate_model",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {"store_users": timed(lambda: common.users(spark, folder))}
    for name in HEADLINE:
        def run(query=QUERIES[name]):
            query(spark, folder).write.format("noop").mode("overwrite").save()

        seconds[name] = min(timed(run) for _ in range(RUNS))
    learn, test = common.halves(spark, folder)
    for recipe in ("logreg_full", "forest_full"):
        seconds[f"fit_{recipe}"] = timed(lambda r=recipe: common.model(spark, folder, r))
    seconds["fit_boosting_full"] = timed(lambda: common.boosted(spark, folder))
    for name in ("predict_proba", "shap_values"):
        def run(query=QUERIES[name]):
            query(spark, folder).write.format("noop").mode("overwrite").save()

        seconds[name] = min(timed(run) for _ in range(RUNS))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
