"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "e8_top_events", "e7_event_losses", "e6_peak_winds", "e5_yearly_event_features", "d3_gold_features", "d8_radius_join",
    "d10_storm_distances", "d11_nearest_neighbours", "d13_co_loss_pairs", "d17_vector_top_k", "e4_training_table",
    "e18_classifier_metrics", "e26_describe", "e27_quality_rules", "e13_tail_metrics", "f4_sequential_ids", "f9_stratified_split",
    "i2_chunk_ids", "i5_grounded_numbers", "k4_risk_book",
]


def main() -> None:
    from pyspark.sql import SparkSession

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("perilframe-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cores)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from perilframe.catalog import QUERIES

    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    QUERIES["c2_radius_of_max_wind"](spark, folder).count()  # start the workers before the clock
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("/sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
