"""Positive-unlabeled and multi-class fits on Spark ML; inputs are (item_id, y, vec) tables."""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.functions.vectors import scaled
from vitrine.learning.datasets import build_xy
from vitrine.learning.models import LinearScorer, Member, unscaled
from vitrine.operators.metrics import auc_and_ap, precision_at_positives, weighted_auc
from vitrine.operators.scale import stored

# Regularisation strengths tried by the search.
C_GRID = (0.01, 0.1, 1.0, 10.0)
# Stop a fit when the loss moves less than this share.
TOL = 1e-4


def moments(df: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and population standard deviation of every feature, in one pass."""
    v = array_to_vector(F.col(vec))
    row = df.agg(F.count("*").alias("n"), Summarizer.mean(v).alias("m"), Summarizer.variance(v).alias("v")).first()
    n = row["n"]
    # Summarizer gives the sample variance
    return n, row["m"].toArray(), np.sqrt(row["v"].toArray() * (max(n - 1, 0) / max(n, 1)))


def standardize(df: DataFrame, fitted=None, vec: str = "vec") -> DataFrame:
    """Scale with the moments of `fitted` (default: of df itself); constant features become 0."""
    _, mean, std = fitted or moments(df, vec)
    factor = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    return df.withColumn(vec, scaled(F.col(vec), mean, factor))


def _ready(train: DataFrame, scale: bool):
    n, mean, std = moments(train)
    if not scale:
        mean, std = np.zeros_like(mean), np.ones_like(std)
    rows = standardize(train, (n, mean, std)).select("item_id", "y", array_to_vector("vec").alias("x")).persist()
    return rows, n, mean, std


def side_by_side(jobs: list, width: int = 4) -> list:
    """Results of independent fits, submitted to Spark together as its own tuning classes do."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(lambda job: job(), jobs))


def _fold(n: int, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "item_id"), F.lit(n))


def fit_elkan_noto(train: DataFrame, name="elkan_noto", feature="", C: float = 1.0, scale=True, seed: int = 42) -> LinearScorer:
    """Logistic regression of labelled against unlabelled rows, divided by P(labelled | positive).

    The divisor is the mean score of a tenth of the positives kept out of the fit.
    """
    rows, n, mean, std = _ready(train, scale)
    held = (F.col("y") == 1) & (_fold(10, seed) == 0)
    lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / (C * n), standardization=False, maxIter=200, tol=TOL)
    model = lr.fit(rows.where(~held))
    w, b = unscaled(model.coefficients.toArray(), model.intercept, mean, std)
    plain = LinearScorer(name, feature, "elkan_noto", [Member(w, b)])
    c = train.where(held).agg(F.avg(plain.score(F.col("vec")))).first()[0]
    rows.unpersist()
    plain.divisor = float(c) if c else 1.0
    return plain


def fit_biased_svm(
    train: DataFrame, pi: float, name="biased_svm", feature="", C: float = 1.0, scale=True, seed: int = 42, folds: int = 3
) -> LinearScorer:
    """Linear SVM with unlabeled rows weighted by the prior; Platt-scaled out of fold, folds averaged."""
    rows, n, mean, std = _ready(train.withColumn("y", F.col("y").cast("double")), scale)
    rows = rows.withColumn("w", F.when(F.col("y") == 1, 1.0).otherwise(float(pi))).withColumn("_f", _fold(folds, seed))

    def fold(f: int) -> Member:
        inside, outside = rows.where(F.col("_f") != f), rows.where(F.col("_f") == f)
        weight = inside.agg(F.sum("w")).first()[0]
        svm = LinearSVC(
            featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / (C * weight), standardization=False, maxIter=100, tol=TOL
        ).fit(inside)
        w, b = unscaled(svm.coefficients.toArray(), svm.intercept, mean, std)
        margin = LinearScorer("", "", "", [Member(w, b)]).margin(F.col("vec"))
        held = train.withColumn("_f", _fold(folds, seed)).where(F.col("_f") == f).select(
            F.col("y").cast("double").alias("y"),
            F.when(F.col("y") == 1, 1.0).otherwise(float(pi)).alias("w"),
            array_to_vector(F.array(margin)).alias("x"),
        )
        platt = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", tol=TOL).fit(held)
        return Member(w, b, float(platt.coefficients[0]), float(platt.intercept))

    members = side_by_side([lambda f=f: fold(f) for f in range(folds)])
    rows.unpersist()
    return LinearScorer(name, feature, "biased_svm", members)


def _auc(model: LinearScorer, rows: DataFrame) -> float:
    scored = rows.select("item_id", "y", model.score(F.col("vec")).alias("score"), F.lit(1.0).alias("weight"))
    return weighted_auc(scored, []).first()["auc"]


def grid_attempts(method: str, train: DataFrame, validation: DataFrame, pi: float, grid=C_GRID, **names) -> list[tuple]:
    """(C, validation AUC, model) of every C in the grid."""

    def attempt(C: float):
        model = fit_elkan_noto(train, C=C, **names) if method == "elkan_noto" else fit_biased_svm(train, pi, C=C, **names)
        return C, _auc(model, validation), model

    return side_by_side([lambda C=C: attempt(C) for C in grid])


def grid_search(method: str, train: DataFrame, validation: DataFrame, pi: float, grid=C_GRID, **names):
    """(best C, its AUC, its model); the first of equal values wins."""
    return max(grid_attempts(method, train, validation, pi, grid, **names), key=lambda found: found[1])


def evaluate_model(model: LinearScorer, rows: DataFrame) -> DataFrame:
    """One row: model, auc, ap and precision at the number of positives."""
    scored = rows.select(
        F.lit(model.name).alias("model"), "item_id", "y", model.score(F.col("vec")).alias("score"), F.lit(1.0).alias("weight")
    )
    return auc_and_ap(scored, ["model"]).join(precision_at_positives(scored, ["model"]), "model")


def train_matrix(
    splits: DataFrame,
    stores: dict[str, tuple[DataFrame, int]],
    labels: list[str],
    methods: list[str],
    known: set[str] = frozenset(),
    overwrite: bool = False,
    max_unlabeled: int | None = None,
    search: bool = False,
    network: bool = False,
) -> tuple[list[LinearScorer], DataFrame | None]:
    """Fit every feature x label x method not known yet; one metrics row each.

    The loop is over model names only, each fit is a Spark job over its rows. The splits and the rows of
    every feature and label are stored once: a fit reads them hundreds of times, and joining them anew
    would send the smaller side through the driver each time. `network` takes the network for nnpu
    instead of the linear model.
    """
    from vitrine.learning.network import fit_nnpu_network
    from vitrine.learning.nnpu import fit_nnpu
    from vitrine.operators.aggregates import class_prior

    models, metrics, splits, rows = [], None, stored(splits.select("item_id", "label", "split")), {}
    for (feature, (store, dim)), label, method in itertools.product(stores.items(), labels, methods):
        name = f"{feature}_{label}_{method}"
        if name in known and not overwrite:
            continue
        if (feature, label) not in rows:
            # only what is fitted on may be capped, never what is measured
            train = stored(build_xy(splits, store, dim, "train", label, max_unlabeled))
            rows[feature, label] = train, stored(build_xy(splits, store, dim, "val", label)), class_prior(splits, label).first()["pi"]
        train, val, pi = rows[feature, label]
        names = {"name": name, "feature": feature}
        if method == "nnpu":
            model = (fit_nnpu_network if network else fit_nnpu)(train, val, pi, **names)
        elif search:
            model = grid_search(method, train, val, pi, **names)[2]
        elif method == "elkan_noto":
            model = fit_elkan_noto(train, **names)
        else:
            model = fit_biased_svm(train, pi, **names)
        models.append(model)
        row = evaluate_model(model, val)
        metrics = row if metrics is None else metrics.unionByName(row)
    return models, metrics


def fit_multiclass(train: DataFrame, kind: str, classes: int = 3, seed: int = 42):
    """Spark ML baseline over (y, vec): tree (depth 10), linear_svc (one against the rest) or mlp."""
    rows = train.select(F.col("y").cast("double").alias("y"), array_to_vector("vec").alias("x"))
    cols = {"featuresCol": "x", "labelCol": "y"}
    if kind == "tree":
        return DecisionTreeClassifier(maxDepth=10, seed=seed, **cols).fit(rows)
    if kind == "linear_svc":
        return OneVsRest(classifier=LinearSVC(tol=TOL, maxIter=50, **cols), parallelism=classes, **cols).fit(rows)
    if kind == "mlp":
        width = train.select(F.size("vec")).first()[0]
        return MultilayerPerceptronClassifier(layers=[width, 64, classes], seed=seed, maxIter=50, tol=TOL, **cols).fit(rows)
    raise ValueError(f"unknown kind: {kind}")


def predict_classes(model, df: DataFrame) -> DataFrame:
    """Adds pred to (…, vec) rows."""
    out = model.transform(df.withColumn("x", array_to_vector("vec")))
    return out.select(*df.columns, F.col("prediction").cast("int").alias("pred"))
