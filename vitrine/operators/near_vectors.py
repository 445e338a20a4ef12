"""Similar-to lists for many items at once, from runs of neighbours along random hyperplane orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.scale import number_rows, skew_join, stored, top_per_group
from vitrine.operators.vectors import DIGITS, _unit_rows, candidates

# Signs of a key: as many neighbours in one order as 2**BITS groups can tell apart.
BITS = 32
# Queries that meet a run in one task.
ASKED = 4096


def sign_keys(vec: Column, dim: int, orders: int, seed: int) -> Column:
    """array<long>: per order one number whose bits are the sides of random hyperplanes, so near vectors share leading bits."""
    planes = np.random.default_rng(seed).normal(size=(dim, orders * BITS))
    weight = 2.0 ** np.arange(BITS - 1, -1, -1)

    @F.arrow_udf("array<long>")
    def keys(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        sides = (x @ planes > 0).reshape(len(x), orders, BITS)
        # walk the sides as a Gray code: numbers next to each other differ in one side
        for i in range(1, BITS):
            sides[:, :, i] ^= sides[:, :, i - 1]
        found = (sides @ weight).astype(np.int64)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * orders, found.ravel())

    return keys(vec)


def _best_of_run(k: int):
    def best(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or points.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "_s": []})
        points = points.sort_values("id_", kind="stable")
        scores = np.round(_unit_rows(queries["vec_"]) @ _unit_rows(points["vec_"]).T, DIGITS)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(queries)), order.shape[1])
        col = order.ravel()
        return pd.DataFrame({"query_id": queries["id_"].to_numpy()[row], "item_id": points["id_"].to_numpy()[col], "_s": scores[row, col]})

    return best


def similar_items_near(
    points: DataFrame,
    queries: DataFrame,
    k: int = 20,
    axis: str = "eva02",
    orders: int = 32,
    run: int = 256,
    seed: int = 11,
    **filters,
) -> DataFrame:
    """query_id, item_id, similarity, rank for every query item: exact similarities, neighbours nearly always the nearest.

    The candidates are put in `orders` orders, each by the sides of 32 random hyperplanes, and
    cut into runs of `run`; a query is held against the run it falls into and the one it is closer to,
    by matrix products, and the best of all orders are ranked by their exact similarity. A run has
    the same size however the vectors are spread, so no group is hot, and the work grows with
    the rows: `orders` copies of each row move, never a pair of blocks. More or longer runs find more.

    Equal vectors take one place: of each only the first k + 1 ids can be returned, and equal
    queries are asked once. Ties go to the smaller id. Zero and null vectors take no part.
    `similar_items_all` is the exact form; both take the same filters.
    """
    # also leaves out vectors without a norm
    live = F.col("norm") > 0
    found = stored(candidates(points, axis, **filters).where(live).select("item_id", "vec"))
    asked = stored(points.where((F.col("axis") == axis) & live).join(queries.select("item_id").distinct(), "item_id", "left_semi").select(F.col("item_id").alias("query_id"), "vec"))
    first = found.select(F.size("vec").alias("n")).first() or asked.select(F.size("vec").alias("n")).first()
    dim = first["n"] if first else 1
    members = top_per_group(found, ["vec"], [F.asc("item_id")], k + 1, "_place")
    members = stored(members.withColumn("node", F.min("item_id").over(Window.partitionBy("vec"))).select("node", "item_id", "vec"))
    singles = stored(asked.groupBy("vec").agg(F.min("query_id").alias("node")))
    nodes = members.where("node = item_id").select(F.col("node").alias("id"), "vec", F.lit(1).alias("_c"), F.lit(0).alias("_q"))
    wanted = singles.select(F.col("node").alias("id"), "vec", F.lit(0).alias("_c"), F.lit(1).alias("_q"))
    both = stored(nodes.unionByName(wanted))
    keyed = both.select("id", "_c", "_q", F.posexplode(sign_keys(F.col("vec"), dim, orders, seed)).alias("_t", "_key"))
    placed = number_rows(keyed, ["_t"], [F.asc("_key"), F.asc("id"), F.asc("_q")], "_r", sums=["_c", "_q"])
    at = stored(placed.select("_t", "id", "_q", F.expr("_c_upto - 1").alias("_at"), F.expr(f"_q_upto div {ASKED}").alias("_chunk")))
    home = F.expr(f"greatest(_at, 0) div {run}")
    side = F.when(F.expr(f"greatest(_at, 0) % {run} < {run // 2}"), home - 1).otherwise(home + 1)
    askers = at.where("_q = 1").select("_t", "id", "_chunk", F.explode(F.array(home, side)).alias("_run")).where("_run >= 0")
    held = at.where("_q = 0").select("_t", "id", F.expr(f"_at div {run}").alias("_run"))
    # a run is copied once for every ASKED queries that fall on it
    held = held.join(askers.select("_t", "_run", "_chunk").distinct(), ["_t", "_run"])
    group = ["_t", "_run", "_chunk"]
    # columns of one stored table on both sides need names of their own
    fresh = lambda df: df.select(*[F.col(c).alias(f"{c}_") for c in [*group, "id", "vec"]])
    left = fresh(askers.join(wanted.select("id", "vec"), "id")).groupBy(*[f"{c}_" for c in group])
    right = fresh(held.join(nodes.select("id", "vec"), "id")).groupBy(*[f"{c}_" for c in group])
    ids = dict(points.dtypes)["item_id"]
    met = left.cogroup(right).applyInPandas(_best_of_run(k + 1), f"query_id {ids}, item_id {ids}, _s double")
    pairs = met.groupBy("query_id", "item_id").agg(F.max("_s").alias("_s"))
    ranked = top_per_group(pairs, ["query_id"], [F.desc("_s"), F.asc("item_id")], k + 1, "_place")
    near = stored(ranked.select(F.col("query_id").alias("_asked"), F.col("item_id").alias("node"), "_s").join(members.select("node", "item_id"), "node"))
    best = stored(top_per_group(near.select("_asked", "item_id", "_s"), ["_asked"], [F.desc("_s"), F.asc("item_id")], k + 1, "_place"))
    # equal queries share their list, each without itself
    told = skew_join(asked, singles.withColumnRenamed("node", "_asked"), ["vec"], "inner", ["query_id"]).select("query_id", "_asked")
    lists = best.groupBy("_asked").agg(F.array_sort(F.collect_list(F.struct("_place", "item_id", "_s"))).alias("_list"))
    own = skew_join(stored(told), lists, ["_asked"], "inner", ["query_id"]).select(
        "query_id", F.posexplode(F.slice(F.filter("_list", lambda e: e.item_id != F.col("query_id")), 1, k)).alias("_i", "_e")
    )
    return own.select("query_id", "_e.item_id", F.round("_e._s", 6).alias("similarity"), (F.col("_i") + 1).cast("long").alias("rank"))
