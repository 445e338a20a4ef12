"""Weighted ranking metrics over a scored table, all models of a table in one job.

Input rows carry the grouping columns (`by`), item_id, y (1 or 0), score, weight and, for
nDCG, relevance. Curves are computed on distinct scores, so ties share one threshold, and
running sums come from range partitions, so one model may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.operators.scale import number_rows, skew_join, stored, top_per_group, top_rows


def _curve(df: DataFrame, by: list[str]) -> DataFrame:
    """Positive and negative weight at every distinct score with running sums from below."""
    weight = F.col("weight").cast("double")
    at = df.groupBy(*by, "score").agg(
        F.sum(F.when(F.col("y") == 1, weight).otherwise(0.0)).alias("wp"),
        F.sum(F.when(F.col("y") == 1, 0.0).otherwise(weight)).alias("wn"),
    )
    return number_rows(at, by, [F.asc("score")], "_rank", sums=["wp", "wn"])


def _auc() -> Column:
    below = F.col("wn_upto") - F.col("wn") / 2
    return F.sum(F.col("wp") * below) / F.nullif(F.max("wp_total") * F.max("wn_total"), F.lit(0.0))


def _ap() -> Column:
    hits = F.col("wp_total") - F.col("wp_upto") + F.col("wp")
    misses = F.col("wn_total") - F.col("wn_upto") + F.col("wn")
    share = F.when(F.col("wp") > 0, F.col("wp") * hits / (hits + misses)).otherwise(0.0)
    return F.sum(share) / F.nullif(F.max("wp_total"), F.lit(0.0))


def auc_and_ap(df: DataFrame, by: list[str]) -> DataFrame:
    """Both curve metrics from one pass."""
    return _curve(df, by).groupBy(*by).agg(_auc().alias("auc"), _ap().alias("ap"))


def weighted_auc(df: DataFrame, by: list[str]) -> DataFrame:
    return _curve(df, by).groupBy(*by).agg(_auc().alias("auc"))


def weighted_ap(df: DataFrame, by: list[str]) -> DataFrame:
    return _curve(df, by).groupBy(*by).agg(_ap().alias("ap"))



def _by_score() -> list[Column]:
    return [F.desc("score"), F.asc("item_id")]


def precision_at_positives(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of positives among the first K rows, K being the number of positives; 0 if none."""
    rows = df.select(*by, "item_id", "score", F.col("y").cast("long").alias("y"))
    ranked = number_rows(rows, by, _by_score(), "_rank", totals=["y"])
    hit = F.sum(F.when(F.col("_rank") <= F.col("y_total"), F.col("y")).otherwise(0))
    return ranked.groupBy(*by).agg(
        F.coalesce(hit / F.nullif(F.max("y_total"), F.lit(0)), F.lit(0.0)).alias("precision")
    )


def _gain() -> Column:
    return (F.pow(2.0, F.col("relevance")) - 1) * F.col("weight")


def _discounted() -> Column:
    return F.sum(F.col("_gain") / F.log2(F.col("_rank") + 1))


def weighted_ndcg_at_k(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """nDCG with gain (2^relevance - 1) * weight; the ideal order is by gain, 0 if it is worth 0."""
    rows = df.withColumn("_gain", _gain())
    real = top_per_group(rows, by, _by_score(), k, "_rank").groupBy(*by).agg(_discounted().alias("_d"))
    ideal = top_per_group(rows, by, [F.desc("_gain"), F.asc("item_id")], k, "_rank").groupBy(*by).agg(_discounted().alias("_i"))
    share = F.when(F.col("_i") > 0, F.col("_d") / F.col("_i")).otherwise(0.0)
    return real.join(ideal, by).select(*by, share.alias("ndcg"))


def weighted_precision_at_k(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """Positive weight among the first k rows over k (or fewer rows); may exceed 1.

    Also gives the positive weight found (`hit_weight`) and in all (`positive_weight`).
    """
    positive = F.sum(F.when(F.col("y") == 1, F.col("weight")).otherwise(0.0))
    top = top_per_group(df, by, _by_score(), k, "_rank").groupBy(*by).agg(
        positive.alias("hit_weight"), F.count("*").alias("_k")
    )
    whole = df.groupBy(*by).agg(positive.alias("positive_weight"))
    return top.join(whole, by).select(
        *by, (F.col("hit_weight") / F.col("_k")).alias("precision"), "hit_weight", "positive_weight"
    )


def _fbeta(beta: float) -> Column:
    """F-beta of a row of `weighted_precision_at_k`."""
    p, square = F.col("precision"), beta * beta
    r = F.col("hit_weight") / F.nullif(F.col("positive_weight"), F.lit(0.0))
    value = F.coalesce((1 + square) * p * r / F.nullif(square * p + r, F.lit(0.0)), F.lit(0.0))
    return value.alias(f"f{beta}".replace(".", "_"))


def fbeta_at_k(df: DataFrame, by: list[str], k: int, betas=(0.5, 1.0)) -> DataFrame:
    """One column f<beta> per beta from weighted precision and weighted recall at k."""
    return weighted_precision_at_k(df, by, k).select(*by, *[_fbeta(b) for b in betas])


def eval_subset(evaluation: DataFrame, label: str, modes=V.WEIGHTING_MODES) -> DataFrame:
    """Positives of a label and the negatives under every weighting mode.

    Adds weighting, y, relevance and weight; `group_weight` (see `group_sizes`) scales all weights.
    """
    label = V.EVAL_LABEL_OF.get(label, label)
    rows = evaluation.where(F.col("label").isin(label, V.NEGATIVE)).withColumn(
        "weighting", F.explode(F.array(*[F.lit(m) for m in modes]))
    )
    y = F.when(F.col("label") == label, 1).otherwise(0)
    dropped = (F.col("weighting") == "r2plus") & (y == 1) & (F.coalesce("rating", F.lit(0)) == 1)
    gain = F.lit(V.UNRATED_GAIN)
    for rating, g in V.RATING_GAIN.items():
        gain = F.when(F.col("rating") == rating, g).otherwise(gain)
    gain = F.when(F.col("weighting") == "unweighted", 1.0).otherwise(gain)
    return (
        rows.where(~dropped)
        .withColumn("y", y)
        .withColumn("relevance", F.when(F.col("y") == 1, gain).otherwise(0.0))
        .withColumn("weight", F.when(F.col("y") == 1, gain).otherwise(1.0) * F.coalesce("group_weight", F.lit(1.0)))
    )


def evaluate(evaluation: DataFrame, by: list[str], k: int, betas=(0.5, 1.0)) -> DataFrame:
    """Every metric of a scored evaluation table, one row per group.

    The columns the metrics read are stored once, as several orders are made of them.
    """
    evaluation = stored(evaluation.select(*by, "item_id", "y", "score", "weight", "relevance"))
    counts = evaluation.groupBy(*by).agg(
        F.count_if(F.expr("y = 1")).alias("n_pos"), F.count_if(F.expr("y = 0")).alias("n_neg")
    )
    out = counts.withColumn("k", F.lit(k))
    parts = [
        weighted_ndcg_at_k(evaluation, by, k),
        auc_and_ap(evaluation, by),
        weighted_precision_at_k(evaluation, by, k).select(*by, "precision", *[_fbeta(b) for b in betas]),
    ]
    for part in parts:
        out = out.join(part, by, "left")
    return out.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def auc_one_vs_rest(scores: DataFrame, classes=(1, 2), mapping=None, by=("model",)) -> DataFrame:
    """AUC and AP per class; `scores` has label and class_scores (map class name to score).

    Unlabeled rows and labels of class 0 are negatives, other positives are left out.
    """
    mapping = mapping or V.LABEL_TO_CLASS
    known = F.create_map(*[x for l, c in mapping.items() for x in (F.lit(l), F.lit(c))])
    rows = scores.withColumn("_class", F.try_element_at(known, F.col("label"))).withColumn(
        "_target", F.explode(F.array(*[F.lit(c) for c in classes]))
    )
    name = F.element_at(F.array(*[F.lit(n) for n in V.CLASS_NAMES]), F.col("_target") + 1)
    rows = rows.where(F.col("_class").isin(0) | (F.col("_class") == F.col("_target"))).select(
        *by,
        "item_id",
        name.alias("class"),
        F.when(F.col("_class") == 0, 0).otherwise(1).alias("y"),
        F.try_element_at(F.col("class_scores"), name).alias("score"),
        F.lit(1.0).alias("weight"),
    )
    return _with_counts(rows, [*by, "class"])


def auc_binary(scores: DataFrame, label: str, by=("model",)) -> DataFrame:
    """AUC and AP of one label against the unlabeled rows."""
    rows = scores.where(F.col("label").isin(label, V.UNLABELED)).select(
        *by, "item_id", "score", F.when(F.col("label") == label, 1).otherwise(0).alias("y"), F.lit(1.0).alias("weight")
    )
    return _with_counts(rows, list(by))


def _with_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups lacking one side are skipped."""
    counts = rows.groupBy(*by).agg(F.count_if(F.expr("y = 1")).alias("n_pos"), F.count_if(F.expr("y = 0")).alias("n_neg"))
    both = counts.where("n_pos > 0 AND n_neg > 0").join(auc_and_ap(rows, by), by)
    return both.withColumn("auc", F.round("auc", 5)).withColumn("ap", F.round("ap", 5))


def metrics_pivot(metrics: DataFrame, metric: str, modes=V.WEIGHTING_MODES) -> DataFrame:
    """Models by weighting mode, best weighted value first."""
    wide = metrics.groupBy("model").agg(
        *[F.max(F.when(F.col("weighting") == m, F.col(metric))).alias(m) for m in modes]
    )
    return wide.orderBy(F.desc_nulls_last(modes[0]), "model")


def summary_sorted(metrics: DataFrame, by_metric: str = "ndcg") -> DataFrame:
    """Weighted rows, best first; label and class share one column."""
    rows = metrics.where("weighting = 'weighted'")
    for c in ("label", "class"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.withColumn("target", F.coalesce("label", "class")).drop("label", "class").orderBy(F.desc(by_metric), "model")


def confusion_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy("y", "pred").agg(F.count("*").alias("n"))


def multiclass_report(df: DataFrame) -> DataFrame:
    """One row: accuracy and macro precision, recall and F1 over the classes seen."""
    cells = confusion_matrix(df)
    truth = cells.groupBy(F.col("y").alias("c")).agg(
        F.sum("n").alias("actual"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit")
    )
    said = cells.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("said"))
    both = truth.join(said, "c", "full").na.fill(0, ["actual", "hit", "said"])
    share = lambda n, d: F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(0.0))
    p, r = share(F.col("hit"), F.col("said")), share(F.col("hit"), F.col("actual"))
    per = both.withColumn("p", p).withColumn("r", r).withColumn("f", F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0)))
    return per.agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        F.avg("p").alias("macro_precision"),
        F.avg("r").alias("macro_recall"),
        F.avg("f").alias("macro_f1"),
    )


def top_class_candidates(test: DataFrame, validation: DataFrame, score: str, n: int = 100) -> DataFrame:
    """Rows of true class 0 that score highest for another class."""
    rows = test.unionByName(validation).where("y = 0")
    return top_rows(rows, [F.desc(score), F.asc("item_id")], n)


def combined_score(scores: DataFrame) -> DataFrame:
    """item_id, combined: the best percent rank of an item among its models."""
    ties = scores.groupBy("model", "score").agg(F.count("*").alias("n"))
    placed = number_rows(ties, ["model"], [F.asc("score")], "_rank", sums=["n"])
    share = (F.col("n_upto") - F.col("n")) / F.nullif(F.col("n_total") - 1, F.lit(0))
    quantiles = placed.select("model", "score", F.coalesce(share, F.lit(0.0)).alias("q"))
    joined = skew_join(scores, quantiles, ["model", "score"], "inner", ["item_id"])
    return joined.groupBy("item_id").agg(F.max("q").alias("combined"))
