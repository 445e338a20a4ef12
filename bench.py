"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from vitrine.operators.scale import drop_stored
from vitrine.plans import catalogue

HEADLINE = [
    "a1_read_posts", "b1_upsert", "e1_enrich", "f3_provider_stats", "f4_duplicate_groups", "f13_median_score_by_rating",
    "g1_score_ranks", "g3_page_items", "g3_deep_page", "g6_confusion_extremes", "h1_dedupe_by_hash", "h2_flag_duplicates",
    "i2_tier_tags", "i4_ordered_tags", "i12_repetition_filter", "j1_similar_items", "j2_similar_items_all",
    "k1_assign_splits", "k10_score_batch", "l1_weighted_auc", "l2_weighted_ap", "l3_precision_at_positives",
    "l4_weighted_ndcg", "l5_weighted_precision", "l6_fbeta", "l7_eval_subset", "m1_moderation_stats", "m1_moderation_stats_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run, seconds = catalogue.queries(), {}
    # start the JVM's reader and planner before the clock
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    for name in HEADLINE:
        start = time.perf_counter()
        run[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    drop_stored(spark)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
