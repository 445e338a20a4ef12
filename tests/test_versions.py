"""Item versions in any order count once; downloads are remembered for a bounded time."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vitrine.operators.aggregates import provider_stats
from vitrine.streaming import versions

CHANGES = "item_id long, version long, after map<string,double>"
DOWNLOADS = "type string, post_id long, downloaded_at timestamp"


def test_shuffled_and_doubled_versions_equal_the_snapshot(spark, tmp_path):
    rng = random.Random(4)
    history, last = [], {}
    for item in range(30):
        for version in range(rng.randrange(1, 5)):
            after = rng.choice([None, {}, {"a": float(rng.randrange(9))}, {"a": 2.0, "b": float(rng.randrange(9))}, {"a": None, "b": 1.0}])
            history.append((item, version, after))
            last[item] = after
    events = history * 2 + [(None, 1, {"a": 5.0}), (3, None, {"a": 5.0})]
    rng.shuffle(events)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 2).parquet(str(folder))
    for part in range(3):
        spark.createDataFrame(events[part::3], CHANGES).coalesce(2).write.mode("append").parquet(str(folder))
        versions.version_stats_stream(stream(), out, str(tmp_path / "cp")).awaitTermination()
    got = {r.provider: (r.n, r.total) for r in versions.version_stats(spark, out).collect()}
    kept = [({k: {"result": v} for k, v in (a or {}).items() if v is not None},) for a in last.values()]
    items = spark.createDataFrame(kept, "moderations map<string,struct<result:double>>")
    assert got == {r.provider: (r.n, r.total) for r in provider_stats(items).collect()}


def at(hour):
    return dt.datetime(2024, 3, 1) + dt.timedelta(hours=hour)


def test_downloads_count_once_over_restarts_and_state_stays_bounded(spark, tmp_path):
    rng = random.Random(9)
    pages = []
    for turn in range(8):
        # two days a page, some rows up to 20 hours late, and posts of earlier pages again
        rows = [("danbooru", turn * 50 + i, at(48 * turn + rng.randrange(-20, 28))) for i in range(50)]
        rows += [("danbooru", rng.randrange(turn * 50 + 50), at(48 * turn + rng.randrange(28))) for _ in range(30)]
        pages.append(rows + [("gelbooru", 7, at(48 * turn)), ("danbooru", 1, None)])
    folder, out = tmp_path / "in", str(tmp_path / "out")
    kept = []
    for turn, rows in enumerate([*pages, pages[0], pages[6]]):
        spark.createDataFrame(rows, DOWNLOADS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(DOWNLOADS).parquet(str(folder))
        query = versions.downloads_stream(spark, stream, out, str(tmp_path / "cp"))
        query.awaitTermination()
        # what is left after the watermark has moved
        kept.append(query.lastProgress.stateOperators[0].numRowsTotal)
    found = spark.read.parquet(out)
    want = {(t, i) for rows in pages for t, i, when in rows if when}
    got = found.select("type", "post_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    # two days are remembered, a page has two days: never more than the files of three pages, however many went before
    assert max(kept) <= 3 * 81 < len(want), kept


def test_batch_of_a_replay_does_not_meet_itself(spark, tmp_path):
    """A batch whose folder was written before its commit was lost gives the same rows again."""
    folder, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    spark.createDataFrame([("a", 1, at(0)), ("a", 1, at(1)), ("a", 2, at(2))], DOWNLOADS).write.parquet(str(folder))
    start = lambda: versions.downloads_stream(spark, spark.readStream.schema(DOWNLOADS).parquet(str(folder)), str(out), str(cp)).awaitTermination()
    start()
    for commit in (cp / "commits").glob("*"):
        commit.unlink()
    start()
    assert spark.read.parquet(str(out)).select("type", "post_id").orderBy("post_id").collect() == [("a", 1), ("a", 2)]


def test_plan_keeps_no_state_without_watermark(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("a").alias("type"), F.col("value").alias("post_id"), F.col("timestamp").alias("downloaded_at"))
    plan = versions.first_downloads(stream)._jdf.queryExecution().logical().toString()
    assert "DeduplicateWithinWatermark" in plan and "EventTimeWatermark" in plan


def test_items_lie_in_few_folders_and_a_replayed_batch_counts_once(spark, tmp_path):
    """Newest versions are joined by Spark: no user code per item, whatever the number of batches."""
    folder, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    stream = lambda: spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(folder))
    run = lambda: versions.version_stats_stream(stream(), str(out), str(cp)).awaitTermination()
    rows = lambda turn: [(i, turn + i % 3, {"a": float(turn)}) for i in range(turn, turn + 5)]
    for turn in range(5):
        spark.createDataFrame(rows(turn), CHANGES).coalesce(1).write.mode("append").parquet(str(folder))
        run()
    assert {f.name for f in (out / "items").iterdir()} >= {f"batch={b}" for b in versions.held_in(5)} and len(list((out / "items").iterdir())) <= 4
    last = {}
    for turn in range(5):
        for i, version, after in rows(turn):
            last[i] = max(last.get(i, (-1, 0.0)), (version, after["a"]))
    want = [("a", len(last), sum(v for _, v in last.values()), max(v for v, _ in last.values()))]
    assert versions.version_stats(spark, str(out)).collect() == want
    for commit in (cp / "commits").glob("*4*"):
        commit.unlink()
    run()
    assert versions.version_stats(spark, str(out)).collect() == want
    plan = versions.newest_versions(spark.createDataFrame(rows(0), CHANGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
