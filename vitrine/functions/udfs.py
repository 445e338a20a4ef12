"""Where user code enters: batch extractors and fitted models given as Python objects."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def extract_features(
    df: DataFrame, extract: Callable[[pd.DataFrame], dict], outputs: dict[str, str], batch: int = 64, key: str = "item_id"
) -> DataFrame:
    """Run a batch extractor over (key, content) rows.

    `extract` gets up to `batch` rows and returns one list per name in `outputs` (name to Spark
    type), so several vectors come from one call. If a batch fails its rows are tried one by one;
    those that fail alone, or have no content, come back with null vectors and the reason in
    `error`. Everything else has a null error, so one bad file never costs its neighbours.
    """
    names = list(outputs)

    def attempt(part: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            got = extract(part)
            return [pd.DataFrame({key: part[key].to_numpy(), **{n: list(got[n]) for n in names}, "error": None})]
        except Exception as e:  # user code may fail in any way
            if len(part) == 1:
                return [failed(part, str(e))]
            log.info("a batch of %d rows failed, trying them alone: %s", len(part), e)
            return [row for n in range(len(part)) for row in attempt(part.iloc[n : n + 1])]

    def failed(part: pd.DataFrame, reason: str) -> pd.DataFrame:
        return pd.DataFrame({key: part[key].to_numpy(), **{n: None for n in names}, "error": reason})

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            empty = pdf["content"].isna()
            if empty.any():
                yield failed(pdf[empty], "no content")
            full = pdf[~empty]
            for start in range(0, len(full), batch):
                yield from attempt(full.iloc[start : start + batch])

    types = ", ".join(f"`{n}` {t}" for n, t in outputs.items())
    return df.select(key, "content").mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, {types}, error string")


def byte_histogram(part: pd.DataFrame) -> dict:
    """A deterministic example extractor: 16 shares of high nibbles. Empty content is an error."""
    rows = []
    for content in part["content"]:
        if not content:
            raise ValueError("empty content")
        counts = np.bincount(np.frombuffer(content, dtype=np.uint8) >> 4, minlength=16)
        rows.append((counts / counts.sum()).astype(np.float32))
    return {"vec": rows}


def model_scores(model, vec: Column) -> Column:
    """Positive score of an object with predict_proba, decision_function or predict, in that order."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = np.vstack(vectors.to_numpy())
            if hasattr(model, "predict_proba"):
                out = np.asarray(model.predict_proba(x))[:, 1]
            elif hasattr(model, "decision_function"):
                out = model.decision_function(x)
            else:
                out = model.predict(x)
            yield pd.Series(np.asarray(out, dtype=float))

    return score(vec)
