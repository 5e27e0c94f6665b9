"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. One warm-up, then the
median of three runs, each forced through the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from souqlytics.session import build_session
from verify.queries import QUERIES

HEADLINE = (
    "v01_global_funnel", "g07_feature_user", "g08_feature_product", "g13_feature_user_category",
    "g14_feature_product_sentiment", "f11_user_features", "f16_feature_table", "k12_retention",
    "t09_normalize", "b10_clean_products", "w11_behavior_logs", "j03_product_kpi",
    "p10_split_rows", "x05_top_k_cosine",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
