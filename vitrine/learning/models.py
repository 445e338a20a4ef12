"""Fitted scorers as plain rows: every linear model is weights, bias and a link, kept in a table."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.keys import sanitize_key
from vitrine.functions.vectors import linear_maps


@dataclass
class Member:
    """One linear part: sigmoid(slope * (weights . x + bias) + shift)."""

    weights: list[float]
    bias: float
    slope: float = 1.0
    shift: float = 0.0


@dataclass
class LinearScorer:
    """Mean of its members' sigmoids over `divisor`; weights apply to raw, unscaled vectors."""

    name: str
    feature: str
    method: str
    members: list[Member] = field(default_factory=list)
    divisor: float = 1.0

    def margin(self, vec: Column) -> Column:
        """Decision value of the first member."""
        return linear_maps(vec, self.members[0].weights, self.members[0].bias)[0]

    def score(self, vec: Column) -> Column:
        return self.link(linear_maps(vec, [m.weights for m in self.members], [m.bias for m in self.members]), 0)

    def link(self, margins: Column, start: int) -> Column:
        """Score from the members' decision values at `start` and after in an array."""
        total = F.lit(0.0)
        for i, m in enumerate(self.members):
            total = total + 1.0 / (1.0 + F.exp(-(m.slope * margins[start + i] + m.shift)))
        return total / (len(self.members) * self.divisor)

    def coefficients(self) -> np.ndarray:
        return np.mean([m.weights for m in self.members], axis=0)

    def row(self) -> tuple[str, str]:
        return self.name, json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "LinearScorer":
        d = json.loads(text)
        return LinearScorer(**{**d, "members": [Member(**m) for m in d["members"]]})


@dataclass
class NetworkScorer:
    """sigmoid of a chain of affine maps with max(0, .) between them; the first map applies to raw vectors."""

    name: str
    feature: str
    method: str
    weights: list[list[list[float]]] = field(default_factory=list)
    biases: list[list[float]] = field(default_factory=list)
    kind: str = "network"

    def margin(self, vec: Column) -> Column:
        maps = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in zip(self.weights, self.biases, strict=True)]

        @F.arrow_udf("double")
        def chain(v: pa.Array) -> pa.Array:
            valid = np.asarray(v.is_valid())
            a = v.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, maps[0][0].shape[0])
            for i, (w, b) in enumerate(maps):
                a = (np.maximum(a, 0) if i else a) @ w + b
            out = np.full(len(valid), np.nan)
            out[valid] = a[:, 0]
            return pa.array(out, mask=~valid)

        return chain(vec)

    def score(self, vec: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin(vec)))

    def row(self) -> tuple[str, str]:
        return self.name, json.dumps(asdict(self))


Scorer = LinearScorer | NetworkScorer


def from_json(text: str) -> Scorer:
    d = json.loads(text)
    return NetworkScorer(**d) if d.get("kind") == "network" else LinearScorer.from_json(text)


def unscaled(weights, bias: float, mean, std) -> tuple[list[float], float]:
    """Move standardisation into the weights; a constant feature has no weight."""
    w, m, s = (np.asarray(a, dtype=float) for a in (weights, mean, std))
    raw = np.divide(w, s, out=np.zeros_like(w), where=s > 0)
    return raw.tolist(), float(bias - raw @ m)


def save_models(spark: SparkSession, models: list[Scorer], path: str) -> None:
    """Append models, one row each."""
    spark.createDataFrame([m.row() for m in models], "name string, model string").write.mode("append").parquet(path)


def load_models(spark: SparkSession, path: str) -> list[Scorer]:
    return [from_json(r["model"]) for r in spark.read.parquet(path).collect()]


def score_batch(items: DataFrame, models: list[Scorer], vectors: dict[str, str], column: str = "inferences") -> DataFrame:
    """Adds a map model name to {score}; `vectors` names the vector column of each feature.

    The linear models of a feature share one matrix product, and the table is read once.
    """
    entries, products = [], {}
    for m in (m for m in models if isinstance(m, NetworkScorer)):
        entries += [sanitize_key(F.lit(m.name)), F.create_map(F.lit("score"), m.score(F.col(vectors[m.feature])))]
    models = [m for m in models if isinstance(m, LinearScorer)]
    for feature in dict.fromkeys(m.feature for m in models):
        members = [p for m in models if m.feature == feature for p in m.members]
        margins = linear_maps(F.col(vectors[feature]), [p.weights for p in members], [p.bias for p in members])
        products[f"_m_{feature}"] = margins
        start = 0
        for m in (m for m in models if m.feature == feature):
            score = F.create_map(F.lit("score"), m.link(F.col(f"_m_{feature}"), start))
            entries += [sanitize_key(F.lit(m.name)), score]
            start += len(m.members)
    return items.withColumns(products).withColumn(column, F.create_map(*entries)).drop(*products)


def score_classes(items: DataFrame, name: str, probabilities: str, classes: list[str], column: str = "inferences") -> DataFrame:
    """Adds the named scores of a multi-class model to the map."""
    fields = [x for i, c in enumerate(classes) for x in (F.lit(c), F.col(probabilities)[i])]
    entry = F.create_map(sanitize_key(F.lit(name)), F.create_map(*fields))
    merged = F.map_concat(F.col(column), entry) if column in items.columns else entry
    return items.withColumn(column, merged)


def scores_long(items: DataFrame, models: list[LinearScorer], vectors: dict[str, str], keep: list[str]) -> DataFrame:
    """`keep`, model, score: the shape the metrics take."""
    scored = score_batch(items, models, vectors, "_i").select(*keep, F.explode("_i").alias("model", "_f"))
    return scored.select(*keep, "model", F.col("_f")["score"].alias("score"))
