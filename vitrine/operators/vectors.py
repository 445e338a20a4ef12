"""Similar-to queries by cosine over named vector axes."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.functions.vectors import linear_maps, norm
from vitrine.operators.scale import top_per_group, top_rows

# Equal similarities may differ in the last bits; order is decided on this many digits.
DIGITS = 9
# Scores a task holds at a time, in double precision; some copies of them live beside.
SCORE_BYTES = 8 << 20
# Vectors of one side of a task, in double precision.
BLOCK_BYTES = 256 << 20


def check_axis(axis: str) -> None:
    if axis not in V.SIMILARITY_AXES:
        raise ValueError(f"axis must be one of {V.SIMILARITY_AXES}")


def candidates(points: DataFrame, axis: str, status: str | None = V.INFERRED, date=None, type=None) -> DataFrame:
    """Points of one axis that may be returned; `status` may list several, comma separated."""
    check_axis(axis)
    rows = points.where(F.col("axis") == axis)
    wanted = [s.strip() for s in (status or "").split(",") if s.strip()]
    if wanted:
        rows = rows.where(F.col("status").isin(wanted))
    if date:
        rows = rows.where(F.col("date") == date)
    return rows.where(F.col("type") == type) if type else rows


def similar_items(
    points: DataFrame, item_id, k: int = 20, axis: str = "eva02", status: str | None = V.INFERRED, date=None, type=None
) -> DataFrame:
    """item_id, similarity, rank of the k points nearest to one item; one lookup, one scan, one top-k."""
    if not 1 <= k <= V.SIMILAR_MAX:
        raise ValueError(f"k must be 1 to {V.SIMILAR_MAX}")
    check_axis(axis)
    mine = points.where((F.col("axis") == axis) & (F.col("item_id") == item_id)).select("vec", "norm").first()
    if mine is None or not mine["norm"]:
        return points.where(F.lit(False)).select("item_id", F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("rank"))
    unit = np.asarray(mine["vec"], dtype=float) / mine["norm"]
    rows = candidates(points, axis, status, date, type).where((F.col("item_id") != item_id) & (F.col("norm") > 0))
    exact = rows.select("item_id", F.round(linear_maps(F.col("vec"), unit)[0] / F.col("norm"), DIGITS).alias("_s"))
    best = top_rows(exact, [F.desc("_s"), F.asc("item_id")], k)
    ranked = top_per_group(best, [], [F.desc("_s"), F.asc("item_id")], k, lanes=0)
    return ranked.select("item_id", F.round("_s", 6).alias("similarity"), "rank")


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.vstack(vectors.to_numpy()).astype(np.float64)
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


def _block_best(k: int):
    def best(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or points.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "_s": []})
        points = points.sort_values("item_id", kind="stable")
        ids, asked = points["item_id"].to_numpy(), queries["query_id"].to_numpy()
        right, left = _unit_rows(points["vec"]).T, _unit_rows(queries["vec"])
        parts, step = [], max(1, SCORE_BYTES // (8 * len(ids)))
        for start in range(0, len(asked), step):
            q = asked[start : start + step]
            scores = np.round(left[start : start + step] @ right, DIGITS)
            scores[q[:, None] == ids[None, :]] = -np.inf
            last = max(0, scores.shape[1] - k)
            bound = np.partition(scores, last, axis=1)[:, last]
            row, col = np.nonzero((scores >= bound[:, None]) & np.isfinite(scores))
            found = scores[row, col]
            # ids ascend with the column, so equal scores stay in id order
            order = np.lexsort((col, -found, row))
            place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            keep = order[place < k]
            parts.append(pd.DataFrame({"query_id": q[row[keep]], "item_id": ids[col[keep]], "_s": found[keep]}))
        return pd.concat(parts)

    return best


def similar_items_all(
    points: DataFrame, queries: DataFrame, k: int = 20, axis: str = "eva02", block: int = 16384, **filters
) -> DataFrame:
    """query_id, item_id, similarity, rank for every query item, exact.

    Queries and candidates are hashed into blocks of about `block` rows, fewer where their vectors
    would take more than BLOCK_BYTES; each task multiplies
    one query block with one candidate block and hands on only k rows per query. Both sides of
    a task are bounded whatever the data holds, and the pair matrix never leaves the task.
    """
    live = F.col("norm") > 0
    found = candidates(points, axis, **filters).where(live).select(
        F.col("item_id").alias("item_id"), F.col("vec").alias("vec")
    )
    asked = (
        points.where((F.col("axis") == axis) & live)
        .join(queries.select("item_id"), "item_id", "left_semi")
        .select(F.col("item_id").alias("query_id"), F.col("vec").alias("vec"))
    )
    longest = found.agg(F.max(F.size("vec"))).first()[0] or 1
    block = max(1, min(block, BLOCK_BYTES // (8 * longest)))
    parts = lambda df: max(1, math.ceil(df.count() / block))
    n_q, n_c = parts(asked), parts(found)
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_q", bucket("query_id", n_q)).withColumn("_c", every(n_c))
    right = found.withColumn("_c", bucket("item_id", n_c)).withColumn("_q", every(n_q))
    ids = dict(points.dtypes)["item_id"]
    best = (
        left.groupBy("_q", "_c")
        .cogroup(right.groupBy("_q", "_c"))
        .applyInPandas(_block_best(k), f"query_id {ids}, item_id {ids}, _s double")
    )
    ranked = top_per_group(best, ["query_id"], [F.desc("_s"), F.asc("item_id")], k)
    return ranked.select("query_id", "item_id", F.round("_s", 6).alias("similarity"), "rank")


def index_vectors(
    items: DataFrame,
    stored: DataFrame,
    statuses: Iterable[str] = (V.INFERRED,),
    only_missing: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Items whose vectors are still to be written, in id order if limited; `.count()` is the dry run."""
    todo = items.where(F.col("status").isin(list(statuses)))
    if only_missing:
        todo = todo.join(stored.select("item_id").distinct(), "item_id", "left_anti")
    return top_rows(todo, [F.asc("item_id")], limit) if limit is not None else todo


def with_norm(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn("norm", norm(F.col(vec)))
