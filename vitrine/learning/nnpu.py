"""Non-negative PU learning: gradients are summed by Spark, only weights live on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.learning.fit import _auc, moments, standardize
from vitrine.learning.models import LinearScorer, Member, unscaled


def _gradient_sums(w: np.ndarray, b: float):
    """Per task: summed loss gradients of both risk parts, weights first, then bias and loss."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = {}
        for pdf in batches:
            x = np.vstack(pdf["vec"].to_numpy()).astype(float)
            y, z = pdf["y"].to_numpy(), x @ w + b
            for part, mask, sign in (("pp", y == 1, -1.0), ("pn", y == 1, 1.0), ("un", y == 0, 1.0)):
                if mask.any():
                    s = sign * z[mask]
                    g = sign / (1.0 + np.exp(-s))
                    row = np.concatenate([g @ x[mask], [g.sum(), np.logaddexp(0.0, s).sum(), mask.sum()]])
                    parts[part] = parts.get(part, 0.0) + row
        for part, row in parts.items():
            yield pd.DataFrame({"part": part, "pos": np.arange(len(row)), "value": row})

    return sums


def _risk_gradient(rows: DataFrame, w: np.ndarray, b: float, pi: float) -> tuple[float, np.ndarray]:
    """(risk, gradient) over all rows; one number per weight comes back to the driver."""
    summed = rows.mapInPandas(_gradient_sums(w, b), "part string, pos int, value double").groupBy("part", "pos").agg(
        F.sum("value").alias("value")
    )
    full = {p: np.zeros(len(w) + 3) for p in ("pp", "pn", "un")}
    for r in summed.collect():
        full[r["part"]][r["pos"]] = r["value"]
    mean = {p: v[:-1] / max(v[-1], 1.0) for p, v in full.items()}
    if full["pp"][-1] == 0:
        total = mean["un"]
    elif full["un"][-1] == 0:
        total = pi * mean["pp"]
    else:
        rest = mean["un"] - pi * mean["pn"]
        total = pi * mean["pp"] + (rest if rest[-1] > 0 else 0.0)
    return float(total[-1]), total[:-1]


def fit_nnpu(
    train: DataFrame,
    validation: DataFrame,
    pi: float,
    name="nnpu",
    feature="",
    epochs: int = 50,
    rate: float = 0.1,
    decay: float = 1e-4,
    check: int = 5,
    patience: int = 10,
    scale: bool = True,
) -> LinearScorer:
    """Linear model minimising the nnPU risk with Adam over full passes.

    Validation AUC is checked every `check` epochs; the best weights are kept and the fit
    stops after `patience` checks without a better one.
    """
    n, mean, std = moments(train)
    if not scale:
        mean, std = np.zeros_like(mean), np.ones_like(std)
    rows = standardize(train, (n, mean, std)).select("y", "vec").persist()
    theta = np.zeros(len(mean) + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    best, best_auc, waited = None, -1.0, 0
    for epoch in range(1, epochs + 1):
        _, g = _risk_gradient(rows, theta[:-1], theta[-1], pi)
        g = g + decay * theta
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        if epoch % check == 0 or epoch == epochs:
            w, b = unscaled(theta[:-1], theta[-1], mean, std)
            model = LinearScorer(name, feature, "nnpu", [Member(w, b)])
            auc = _auc(model, validation) or 0.0
            if auc > best_auc:
                best, best_auc, waited = model, auc, 0
            else:
                waited += 1
            if waited >= patience:
                break
    rows.unpersist()
    return best
