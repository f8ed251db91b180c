"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ordermill import catalog
from ordermill.session import build_session

HEADLINE = (
    "monthly_revenue", "category_revenue", "state_delivery", "top_sellers", "cohort_repeat", "rfm",
    "check_constraints", "keep_latest_review", "zip_centroid", "fact_order_items", "measures_total",
    "measures_by_month", "measures_by_state", "category_economics", "score_by_delay",
    "order_value_stats", "order_value_hist", "category_pareto", "payment_value_share", "repeat_gap",
    "feature_table", "stratified_split", "roc_auc",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["monthly_revenue"](spark, folder).collect()  # start the JVM and the code caches
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
