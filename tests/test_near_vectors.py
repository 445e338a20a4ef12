"""Approximate similar-to lists against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import near_vectors, vectors


def points_of(spark, rows):
    df = spark.createDataFrame([(i, v.tolist() if v is not None else None, s) for i, (v, s) in enumerate(rows)], "item_id long, vec array<double>, status string")
    return vectors.with_norm(df.withColumn("axis", F.lit("style")))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(centres[i % 12] + 0.4 * rng.normal(size=16), "inferred" if i % 5 else "pending") for i in range(900)]
    # a third of all rows is one vector
    rows += [(centres[0], "inferred")] * 450 + [(np.zeros(16), "inferred"), (None, "inferred")]
    return points_of(spark, rows).repartition(3).persist()


def test_most_of_the_nearest_are_found_with_exact_similarities(spark, points):
    asked = points.where("item_id % 3 = 0").select("item_id")
    exact = {(r.query_id, r.item_id): r.similarity for r in vectors.similar_items_all(points, asked, 6, "style").collect()}
    near = near_vectors.similar_items_near(points, asked, 6, "style", run=64).collect()
    found = {(r.query_id, r.item_id): r.similarity for r in near}
    assert len(found) == len(near) == len(exact)
    both = exact.keys() & found.keys()
    assert len(both) >= 0.9 * len(exact) and all(abs(exact[p] - found[p]) < 2e-6 for p in both)
    lists = {}
    for r in sorted(near, key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, []).append(r)
    for q, rows in lists.items():
        assert [r.rank for r in rows] == list(range(1, 7)) and q not in [r.item_id for r in rows]
        assert [r.similarity for r in rows] == sorted((r.similarity for r in rows), reverse=True)
    # equal vectors come back in order of id, each without itself
    assert [r.item_id for r in lists[903]] == [900, 901, 902, 904, 905, 906]


def test_runs_that_hold_all_are_exact(spark, points):
    few = points.where("item_id < 100").persist()
    ask = few.select("item_id")
    key = lambda df: sorted(map(tuple, df.select("query_id", "item_id", "similarity", "rank").collect()))
    assert key(near_vectors.similar_items_near(few, ask, 5, "style", orders=2, run=400)) == key(vectors.similar_items_all(few, ask, 5, "style"))
    assert near_vectors.similar_items_near(few.limit(0), ask, 5, "style").count() == 0


def test_groups_of_a_task_are_bounded_and_keys_are_signs(spark, points):
    keys = points.where("norm > 0").select(near_vectors.sign_keys(F.col("vec"), 16, 3, 5).alias("k"), near_vectors.sign_keys(F.transform("vec", lambda x: 7 * x), 16, 3, 5).alias("l"))
    rows = keys.collect()
    assert all(r.k == r.l and len(r.k) == 3 and all(0 <= v < 2**near_vectors.BITS for v in r.k) for r in rows)


def test_exact_block_holds_few_scores_at_a_time():
    import tracemalloc

    import pandas as pd
    from vitrine.operators import vectors

    x = np.random.default_rng(2).normal(size=(6000, 16)).astype(np.float32)
    queries = pd.DataFrame({"query_id": np.arange(600), "vec": list(x[:600])})
    points = pd.DataFrame({"item_id": np.arange(6000), "vec": list(x)})
    tracemalloc.start()
    got = vectors._block_best(3)(queries, points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    scores = unit[:600] @ unit.T
    scores[np.arange(600), np.arange(600)] = -np.inf
    assert (got["item_id"].to_numpy().reshape(600, 3) == np.argsort(-scores, axis=1, kind="stable")[:, :3]).all()
    assert peak < 45 << 20, peak
