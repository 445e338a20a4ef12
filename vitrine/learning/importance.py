"""Which tags move a score: coefficients, mean gradients and per-item contributions."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.vectors import linear_maps
from vitrine.learning.models import LinearScorer
from vitrine.operators.scale import broadcast_if_small, seeded_order, top_per_group, top_rows


def coefficients(spark, models: list[LinearScorer]) -> DataFrame:
    """model, idx, coef with the folds of a model averaged; as long as a vector."""
    rows = [(m.name, i, float(c)) for m in models for i, c in enumerate(m.coefficients())]
    return spark.createDataFrame(rows, "model string, idx int, coef double")


def mean_gradients(df: DataFrame, model: LinearScorer, n: int | None = None, seed: int = 42, vec: str = "vec") -> DataFrame:
    """model, idx, coef: mean derivative of the score with respect to each input, over all rows.

    With `n` it samples: the first n rows of a seeded order.
    """
    picked = df if n is None else top_rows(df.withColumn("_h", seeded_order(seed)), [F.asc("_h"), F.asc("item_id")], n)
    slopes = []
    for m in model.members:
        s = 1.0 / (1.0 + F.exp(-(m.slope * linear_maps(F.col(vec), m.weights, m.bias)[0] + m.shift)))
        slopes.append(F.avg(s * (1 - s) * m.slope / (len(model.members) * model.divisor)))
    means = picked.agg(*[s.alias(f"s{i}") for i, s in enumerate(slopes)])
    gradient = F.lit([0.0] * len(model.members[0].weights))
    for i, m in enumerate(model.members):
        slope = F.col(f"s{i}")
        gradient = F.zip_with(gradient, F.lit(m.weights), lambda g, w: g + w * slope)
    return means.select(F.lit(model.name).alias("model"), F.posexplode(gradient).alias("idx", "coef"))


def class_coefficients(spark, model, classes: list[str]) -> DataFrame:
    """model, idx, coef of every class of a one-against-the-rest linear model; as long as a vector."""
    rows = [(c, i, float(v)) for c, m in zip(classes, model.models, strict=True) for i, v in enumerate(m.coefficients.toArray())]
    return spark.createDataFrame(rows, "model string, idx int, coef double")


def class_gradients(df: DataFrame, model, classes: list[str], vec: str = "vec") -> DataFrame:
    """model, idx, coef: mean derivative of every class's output by each input, over all rows.

    `model` is a network with one hidden layer. An output's derivative is linear in the slopes of
    the hidden units, so only their means over the rows are needed: one aggregate of one number
    per unit.
    """
    width, hidden, outs = model.getLayers()
    flat, at = model.weights.toArray(), hidden * (width + 1)
    inner = flat[: hidden * width].reshape(width, hidden).T
    outer = flat[at : at + outs * hidden].reshape(hidden, outs).T
    slope = lambda z: 1.0 / (1.0 + F.exp(-z)) * (1.0 - 1.0 / (1.0 + F.exp(-z)))
    slopes = F.transform(linear_maps(F.col(vec), inner, flat[hidden * width : at]), slope)
    mean = df.agg(Summarizer.mean(array_to_vector(slopes)).alias("m")).first()["m"]
    gradients = (outer * mean.toArray()) @ inner if mean is not None else np.zeros((outs, width))
    rows = [(c, i, float(v)) for c, g in zip(classes, gradients, strict=True) for i, v in enumerate(g)]
    return df.sparkSession.createDataFrame(rows, "model string, idx int, coef double")


def feature_importance(coefs: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """rank, tag, coef, idx of the k largest and k smallest coefficients of each model."""
    rows = coefs.join(broadcast_if_small(vocabulary.select("idx", "tag")), "idx")
    top = top_per_group(rows, ["model"], [F.desc("coef"), F.asc("idx")], k, lanes=0).withColumn("direction", F.lit("positive"))
    low = top_per_group(rows, ["model"], [F.asc("coef"), F.asc("idx")], k, lanes=0).withColumn("direction", F.lit("negative"))
    return top.unionByName(low).select("model", "direction", "rank", "tag", F.round("coef", 6).alias("coef"), "idx")


def tag_contributions(items: DataFrame, coefs: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """item_id, idx, contribution: the k most positive and k most negative of every item, each once.

    Coefficients are as long as a vector, so they ride along as one array and every item is
    sorted within its own row; nothing is shuffled.
    """
    table = coefs.agg(F.array_sort(F.collect_list(F.struct("idx", "coef")))).scalar()
    value = lambda c: F.get(F.col("_v"), c["idx"]).cast("double") * c["coef"]
    parts = lambda sign: F.array_sort(
        F.transform("_c", lambda c: F.struct((sign * value(c)).alias("v"), c["idx"].alias("idx")))
    )
    rows = items.select("item_id", F.col(vec).alias("_v"), table.alias("_c")).select(
        "item_id", F.slice(parts(-1), 1, k).alias("_high"), F.slice(parts(1), 1, k).alias("_low")
    )
    back = lambda c, sign: F.transform(c, lambda e: F.struct(e["idx"].alias("idx"), (sign * e["v"]).alias("contribution")))
    both = F.explode(F.array_distinct(F.concat(back("_high", -1), back("_low", 1))))
    return rows.select("item_id", both.alias("_e")).select("item_id", "_e.idx", "_e.contribution")
