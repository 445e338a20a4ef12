"""Splits and training tables for positive-unlabeled learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.operators.joins import load_features
from vitrine.operators.scale import number_rows, seeded_order


def assign_splits(manifest: DataFrame, seed: int = 42) -> DataFrame:
    """Adds split: per label the first rows of a seeded order are val, the next test, the rest train.

    Sizes are the half-even rounded ratios, at least 1 each.
    """
    ratios = lambda i: F.when(F.col("label") == V.UNLABELED, V.UNLABELED_RATIOS[i]).otherwise(V.POSITIVE_RATIOS[i])
    size = lambda i: F.greatest(F.lit(1), F.bround(F.col("_n") * ratios(i)).cast("long"))
    ranked = number_rows(
        manifest.withColumn("_h", seeded_order(seed)), ["label"], [F.asc("_h"), F.asc("item_id")], "_rank", "_n"
    )
    split = F.when(F.col("_rank") <= size(0), "val").when(F.col("_rank") <= size(0) + size(1), "test").otherwise("train")
    return ranked.withColumn("split", split).drop("_h", "_rank", "_n")


def labelled_rows(splits: DataFrame, split: str, label: str, max_unlabeled: int | None = None, seed: int = 42) -> DataFrame:
    """item_id, y of a split: 1 for the label, 0 for unlabeled; other positives are left out.

    The cap keeps exactly that many unlabeled rows, chosen by a seeded order.
    """
    rows = splits.where((F.col("split") == split) & F.col("label").isin(label, V.UNLABELED))
    rows = rows.select("item_id", F.when(F.col("label") == label, 1).otherwise(0).alias("y"))
    if max_unlabeled is None:
        return rows
    unlabeled = rows.where("y = 0").withColumn("_h", seeded_order(seed))
    kept = number_rows(unlabeled, [], [F.asc("_h"), F.asc("item_id")], "_rank").where(F.col("_rank") <= max_unlabeled)
    return rows.where("y = 1").unionByName(kept.select("item_id", "y"))


def build_xy(
    splits: DataFrame, store: DataFrame, dim: int, split: str, label: str, max_unlabeled: int | None = None, seed: int = 42
) -> DataFrame:
    """item_id, y, vec; a row without stored vector gets zeros."""
    rows = labelled_rows(splits, split, label, max_unlabeled, seed)
    return load_features(rows, store, dim).select("item_id", "y", "vec")


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))


def nnpu_risk(scored: DataFrame, pi: float | Column, by: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """Non-negative PU risk (Kiryo et al. 2017) of decision values `score` with labels `y`."""
    z, pi = F.col(score), pi if isinstance(pi, Column) else F.lit(float(pi))
    mean = lambda y, v: F.avg(F.when(F.col("y") == y, v))
    terms = scored.groupBy(*by).agg(
        mean(1, softplus(-z)).alias("_pp"), mean(1, softplus(z)).alias("_pn"), mean(0, softplus(z)).alias("_un")
    )
    p, n, u = F.col("_pp"), F.col("_pn"), F.col("_un")
    risk = F.when(p.isNull(), u).when(u.isNull(), pi * p).otherwise(pi * p + F.greatest(u - pi * n, F.lit(0.0)))
    return terms.select(*by, risk.alias("risk"))


def replace_metrics(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Replace metric rows by (model, k, weighting); old rows without weighting are weighted ones."""
    from vitrine.sources.sinks import replace_by_key

    if "weighting" not in existing.columns:
        existing = existing.withColumn("weighting", F.lit(None).cast("string"))
    filled = existing.withColumn("weighting", F.coalesce("weighting", F.lit(V.WEIGHTING_MODES[0])))
    return replace_by_key(filled, new, ["model", "k", "weighting"])
