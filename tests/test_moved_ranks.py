"""Ranks kept by bands equal ranks taken anew, and only touched bands are read or written."""

import os
import random

from pyspark.sql import functions as F

from vitrine.operators.scale import number_rows
from vitrine.streaming import moved_ranks

CHANGES = "item_id long, date string, model string, field string, before double, after double, version long"


def test_ranks_after_random_batches_equal_ranks_taken_anew(spark, tmp_path):
    rng, path, now = random.Random(2), str(tmp_path / "ranks"), {}
    for turn in range(3):
        rows = []
        for version in range(60):
            key = (rng.randrange(25), f"2024-01-0{rng.randrange(1, 3)}", rng.choice(["m.1", "m2"]), "score")
            after = rng.choice([None, 0.5, rng.uniform(-1, 1), rng.uniform(-1, 1), float("nan"), float("inf")])
            rows.append((*key, now.get(key), after, version))
            now[key] = after
        rows += [(None, "2024-01-01", "m2", "score", None, 0.1, 1), (1, None, "m2", "score", None, 0.1, 1)]
        batch = spark.createDataFrame(rows, CHANGES).repartition(3)
        moved_ranks.move_scores(batch, path, 0.3)
        if turn == 1:
            moved_ranks.move_scores(batch, path, 0.3)
        kept = spark.createDataFrame([(*k, v) for k, v in now.items() if v is not None], "item_id long, date string, model string, field string, value double")
        want = number_rows(kept, moved_ranks.RANKED, [F.desc("value"), F.asc("item_id")], "rank", "total").select("item_id", "date", "model", "field", "rank", "total")
        got = moved_ranks.moved_ranks(spark, path).select("item_id", "date", "model", "field", "rank", "total")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one = moved_ranks.moved_ranks(spark, path, "2024-01-01")
    assert {r.date for r in one.collect()} == {"2024-01-01"}


def test_a_change_leaves_other_bands_alone(spark, tmp_path):
    path = str(tmp_path / "ranks")
    rows = [(i, "2024-01-01", "m", "score", None, i / 100, 0) for i in range(100)]
    moved_ranks.move_scores(spark.createDataFrame(rows, CHANGES), path, 0.1)
    files = lambda: {os.path.join(at, n) for at, _, names in os.walk(f"{path}/scores") for n in names if n.endswith(".parquet")}
    before = files()
    moved_ranks.move_scores(spark.createDataFrame([(3, "2024-01-01", "m", "score", 0.03, 0.955, 1)], CHANGES), path, 0.1)
    changed = {f.split("band=")[1].split("/")[0] for f in before ^ files()}
    assert changed == {"0", "9"}
    ranks = {r.item_id: r.rank for r in moved_ranks.moved_ranks(spark, path).collect()}
    assert ranks[3] == 5 and ranks[95] == 6 and ranks[4] == 97 and ranks[2] == 98
    # the scan is told the touched folders
    touched = spark.createDataFrame([("2024-01-01", 9)], "date string, band int")
    plan = moved_ranks._inside(spark, path, touched, "long")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "place" in line]
    assert scans and all("PartitionFilters: [" in line and "band#" in line.split("PartitionFilters: ")[1].split("PushedFilters")[0] for line in scans)


def test_a_band_that_empties_and_fills_again(spark, tmp_path):
    path = str(tmp_path / "ranks")
    step = lambda before, after, version: moved_ranks.move_scores(spark.createDataFrame([(1, "2024-01-01", "m", "s", before, after, version)], CHANGES), path)
    step(None, 0.5, 0)
    step(0.5, None, 1)
    assert moved_ranks.moved_ranks(spark, path).count() == 0
    step(None, 0.52, 2)
    assert [(r.value, r.rank, r.total) for r in moved_ranks.moved_ranks(spark, path).collect()] == [(0.52, 1, 1)]
