"""Counts, sums and summaries; all combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.operators.scale import number_rows, skew_join


def daily_counts(items: DataFrame, month: str, type: str | None = None) -> DataFrame:
    """Inferred items per day of a month; the prefix test reaches the scan."""
    rows = items.where((F.col("status") == V.INFERRED) & F.col("date").startswith(month))
    if type:
        rows = rows.where(F.col("type") == type)
    return rows.groupBy("date").agg(F.count("*").alias("n"))


def counts_by_type(items: DataFrame, date: str, types=None) -> DataFrame:
    """One row: how many items of each type a date has."""
    day = items.where(F.col("date") == date)
    return day.agg(*[F.count_if(F.col("type") == t).alias(t) for t in (types or V.PROVIDERS)])


def provider_stats(items: DataFrame, column: str = "moderations") -> DataFrame:
    """Count, sum and mean of the numeric results of every provider."""
    rows = items.select(F.explode(column).alias("provider", "entry"))
    result = F.col("entry.result").cast("double")
    return (
        rows.where(result.isNotNull())
        .groupBy("provider")
        .agg(F.count("*").alias("n"), F.sum(result).alias("total"))
        .withColumn("mean", F.round(F.col("total") / F.col("n"), 2))
    )


def duplicate_groups(items: DataFrame, hash: str = "sha256", member: str = "key") -> DataFrame:
    """Members of every group of equal content, one row each with the group size.

    Groups stay long tables: a list per group would put a popular file into one row.
    """
    rows = items.where(F.col(hash).isNotNull()).select(hash, member)
    groups = rows.groupBy(hash).agg(F.count("*").alias("n")).where("n > 1")
    return skew_join(rows, groups, [hash], "inner", [member])


def group_sizes(df: DataFrame, group: str = "artwork_id", spread: str = "item_id") -> DataFrame:
    """Adds artwork_group_size (null without group) and weight 1/size."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("artwork_group_size"))
    joined = skew_join(df, sizes, [group], "left", [spread])
    size = F.col("artwork_group_size")
    return joined.withColumn("group_weight", F.when(size > 1, 1.0 / size).otherwise(1.0))


def split_summary(splits: DataFrame, names=("train", "val", "test")) -> DataFrame:
    """Rows per label and split, 0 where empty, with a total."""
    return splits.groupBy("label").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in names], F.count("*").alias("total")
    )


def eval_summary(evaluation: DataFrame) -> DataFrame:
    """Counts by label, by source and by rating in one pass, as (facet, value, n)."""
    sets = evaluation.groupingSets([["label"], ["source"], ["rating"]], "label", "source", "rating").agg(
        F.count("*").alias("n"), F.grouping_id().alias("_g")
    )
    facet = F.when(F.col("_g") == 3, "label").when(F.col("_g") == 5, "source").otherwise("rating")
    value = F.when(F.col("_g") == 3, F.col("label")).when(F.col("_g") == 5, F.col("source")).otherwise(
        F.col("rating").cast("string")
    )
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


def artwork_summary(evaluation: DataFrame) -> DataFrame:
    """One row: artworks, images in works of several pages, largest work."""
    sizes = evaluation.where("artwork_id IS NOT NULL").groupBy("artwork_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("artworks"),
        F.count_if(F.expr("n > 1")).alias("multi_page"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
    )


def label_progress(files: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: total, labeled, skipped and remaining files."""
    state = files.join(labels.select("path", "label"), "path", "left")
    skipped = F.col("label") == V.SKIP
    return state.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("label").isNotNull() & ~skipped).alias("labeled"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(F.col("label").isNull()).alias("remaining"),
    )


def class_prior(splits: DataFrame, label: str, split: str = "train") -> DataFrame:
    """Share of positives among positives and unlabeled rows of a split."""
    rows = splits.where((F.col("split") == split) & F.col("label").isin(label, V.UNLABELED))
    return rows.agg((F.count_if(F.col("label") == label) / F.count("*")).alias("pi"))


def category_distribution(tags: DataFrame) -> DataFrame:
    return tags.groupBy("category").agg(F.count("*").alias("n"))


def usage_cost(log: DataFrame, by=("model",)) -> DataFrame:
    """Token sums and their price; a missing reasoning count is 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    sums = log.groupBy(*by).agg(*[total(c) for c in ("prompt", "completion", "total", "reasoning")])
    million = 1_000_000
    return sums.withColumn("input_cost", F.col("prompt") * V.INPUT_PRICE / million).withColumn(
        "output_cost", (F.col("completion") + F.col("reasoning")) * V.OUTPUT_PRICE / million
    ).withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))


def page_count(stats: DataFrame, size: int = V.PAGE_SIZE, total: str = "n") -> DataFrame:
    return stats.withColumn("pages", F.ceil(F.col(total) / size))


def exact_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n and exact median per group from running counts over distinct values; no group is collected."""
    ties = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    placed = number_rows(ties, group, [F.asc(value)], "_rank", sums=["n"])
    holds = lambda row: F.when((F.col("n_upto") >= row) & (F.col("n_upto") - F.col("n") < row), F.col(value))
    low, high = F.floor((F.col("n_total") + 1) / 2), F.floor(F.col("n_total") / 2) + 1
    return placed.groupBy(*group).agg(
        F.max("n_total").alias("n"), ((F.max(holds(low)) + F.max(holds(high))) / 2).alias("median")
    )


def median_score_by_rating(scored: DataFrame, by=("model",)) -> DataFrame:
    """n and median score of the positives of each rating 1 to 3."""
    rated = scored.where(F.col("rating").isin(1, 2, 3))
    return exact_median(rated, [*by, "rating"], "score").withColumn("median", F.round("median", 4))


def job_counters(rows: DataFrame, outcome: Column) -> DataFrame:
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
