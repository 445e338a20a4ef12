"""What the optimizer must keep doing: pruning, pushdown, top-k and early limits."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vitrine.operators import aggregates, joins, ranking
from vitrine.plans import catalogue
from vitrine.plans.fixtures import items
from vitrine.sources import sinks
from vitrine.sources.landing import PAGE_SCHEMA, posts_of_pages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "items")
    df = items(spark, SMALL).withColumn("inferences", F.struct(F.struct(F.col("m1_score").alias("score")).alias("m1"), F.struct(F.col("m2_score").alias("score")).alias("m2")))
    df.write.partitionBy("date").parquet(path)
    return spark.read.parquet(path)


def test_page_prunes_structs_and_partitions(table):
    page, _ = ranking.page_items(table, "inferences.m1.score", date="2024-01-05")
    text = plan(page.select("item_id", "value"))
    assert "TakeOrderedAndProject" in text
    assert "PartitionFilters: [isnotnull(date" in text
    assert "EqualTo(status,inferred)" in text and "IsNotNull(inferences.m1.score)" in text
    assert "m2" not in text.split("ReadSchema")[1] and "vec" not in text.split("ReadSchema")[1]


def test_month_counts_read_only_their_partitions(table):
    text = plan(aggregates.daily_counts(table, "2024-01"))
    assert "StartsWith(" in text.split("PartitionFilters")[1].split("]")[0]
    assert "ReadSchema: struct<status:string>" in text


def test_top_lists_are_cut_before_the_shuffle(table):
    rows = table.select("type", "item_id", F.col("m1_score").alias("score"))
    text = plan(ranking.top_bottom(rows, "score", 10, by=["type"]))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", [n for n in sorted(catalogue.queries()) if n.startswith(("d", "e", "h", "j"))])
def test_no_cross_join(spark, name):
    assert "CartesianProduct" not in plan(catalogue.queries()[name](spark, SMALL))


def test_small_batches_do_not_shuffle_the_target(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = table.limit(5).select("item_id", F.lit("x").alias("status"))
        text = plan(sinks.upsert(table, batch, ["item_id"]))
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text.split("Union")[1].split("FileScan")[0]
        assert "SortMergeJoin" not in plan(table.transform(lambda t: joins.anti_existing(batch, t, ["item_id"]))).split("BroadcastHashJoin")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_landed_page_is_read_once_and_not_again_for_each_post(spark):
    pages = spark.createDataFrame([(1, 200, '{"contents": [{"illust_id": 5}, {"illust_id": 6}], "date": "20240105"}', None, "daily")], PAGE_SCHEMA)
    posts = posts_of_pages(pages, "pixiv")
    assert [(r["post_id"], r["asked"], r["index"]) for r in posts.orderBy("index").collect()] == [(5, "20240105", 0), (6, "20240105", 1)]
    above, _, below = posts._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert "body" not in above and "body" in below
