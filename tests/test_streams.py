import datetime as dt
import json

from pyspark.sql import functions as F

from vitrine.operators.aggregates import provider_stats
from vitrine.sources import landing
from vitrine.streaming import changes, ingest

SCHEMA = "before map<string,double>, after map<string,double>, changed_at timestamp"


def row(before, after, second=0):
    return (before, after, dt.datetime(2024, 1, 1, 0, 0, second))


CASES = [
    row(None, {"a": 3.0}),  # add
    row({"a": 3.0}, {"a": 5.0}, 1),  # update
    row({"b": 2.0}, {}, 2),  # remove
    row({"a": 4.0}, {"a": 4.0}, 3),  # unchanged
    row({"a": None}, {"a": None}, 4),  # both missing
    row({"c": 0.0}, None, 5),  # item deleted
]


def test_deltas(spark):
    got = changes.moderation_deltas(spark.createDataFrame(CASES, SCHEMA)).select("provider", "count_delta", "sum_delta").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 2.0), ("a", 1, 3.0), ("b", -1, -2.0), ("c", -1, 0.0)]


def lines(rows):
    return "\n".join(json.dumps({"before": b, "after": a, "changed_at": t.isoformat()}) for b, a, t in rows)


def test_stream_equals_recompute_over_restarts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    states = [{"a": 1.0}, {"a": 2.0, "b": 7.0}, {"b": 7.0}, {"a": 9.0, "c": 1.0}]
    stream = lambda: spark.readStream.schema(SCHEMA).json(str(source))
    for i in range(3):
        rows = [row(states[k - 1] if k else None, states[k], k) for k in range(i + 1)] if i == 2 else [row(None, states[i])]
        (source / f"{i}.json").write_text(lines(rows))
        changes.moderation_stats_stream(stream(), out, str(tmp_path / "cp")).awaitTermination()
    got = {r["provider"]: (r["n"], r["total"]) for r in changes.latest_stats(spark, out).collect()}
    final = [states[0], states[1], states[2]]
    items = spark.createDataFrame([({p: {"result": v} for p, v in s.items()},) for s in final], "moderations map<string,struct<result:double>>")
    want = {r["provider"]: (r["n"], r["total"]) for r in provider_stats(items).collect()}
    assert {p: v for p, v in got.items() if v != (0, 0.0)} == want
    # nothing new: the table stays
    changes.moderation_stats_stream(stream(), out, str(tmp_path / "cp")).awaitTermination()
    assert changes.latest_stats(spark, out).count() == len(got)


def page(number, ids):
    posts = [{"id": i, "file_url": f"https://x/{i}.jpg"} for i in ids]
    return json.dumps({"page": number, "status": 200, "body": json.dumps(posts)})


def test_ingest_resumes_and_isolates(spark, tmp_path):
    land, out = tmp_path / "land", str(tmp_path / "items")
    land.mkdir()
    hashes = spark.createDataFrame([(f"https://x/{i}.jpg", f"h{i % 5}") for i in range(12)], "url string, sha256 string")
    empty = spark.createDataFrame([], "type string, post_id long, key string, sha256 string")

    def stored():
        try:
            return spark.read.parquet(out).select("type", "post_id", "key", "sha256", "batch")
        except Exception:
            return empty

    def start():
        return ingest.ingest_stream(spark, str(land), "danbooru", stored, hashes, out, str(tmp_path / "cp"))

    def broken():
        raise RuntimeError("no such source")

    (land / "0.json").write_text(page(0, range(6)))
    outcome = ingest.ingest_all({"broken": broken, "danbooru": start})
    assert outcome["danbooru"] is None and "no such source" in outcome["broken"]
    (land / "1.json").write_text(page(1, range(4, 10)))
    assert ingest.ingest_all({"danbooru": start}) == {"danbooru": None}
    got = {r["post_id"]: r["status"] for r in spark.read.parquet(out).collect()}
    assert got == {**{i: "pending" for i in range(5)}, **{i: "deduped" for i in range(5, 10)}}
    assert spark.read.parquet(out).count() == 10


def test_posts_without_a_hash_and_bad_pages_are_kept(spark, tmp_path):
    land, out, dead = tmp_path / "land", str(tmp_path / "items"), str(tmp_path / "dead")
    land.mkdir()
    (land / "0.json").write_text(page(0, range(6)) + "\n" + json.dumps({"page": 1, "status": 500, "body": "busy"}))
    hashes = spark.createDataFrame([(f"https://x/{i}.jpg", f"h{i}" if i != 3 else None) for i in range(4)], "url string, sha256 string")
    empty = spark.createDataFrame([], "type string, post_id long, key string, sha256 string")
    start = lambda: ingest.ingest_stream(spark, str(land), "danbooru", lambda: empty, hashes.where("sha256 IS NOT NULL"), out, str(tmp_path / "cp"), dead)
    assert ingest.ingest_all({"danbooru": start}) == {"danbooru": None}
    assert sorted(r["post_id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    assert sorted(r["post_id"] for r in spark.read.parquet(f"{dead}/posts").collect()) == [3, 4, 5]
    assert [r["status"] for r in spark.read.parquet(f"{dead}/pages").collect()] == [500]


def test_rank_table_replaces_only_its_dates(spark, tmp_path):
    def items(rows):
        return spark.createDataFrame([(i, d, "inferred", {"m": {"score": s}}) for i, d, s in rows], "item_id long, date string, status string, inferences map<string,map<string,double>>")

    path = str(tmp_path / "ranks")
    ingest.refresh_ranks(items([(1, "2024-01-01", 0.1), (2, "2024-01-01", 0.2), (3, "2024-01-02", 0.3)]), path)
    ingest.refresh_ranks(items([(1, "2024-01-01", 0.9), (2, "2024-01-01", 0.2)]), path)
    got = {r["item_id"]: (r["rank"], r["total"]) for r in spark.read.parquet(path).collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (1, 1)}
    # the only item of the second day is gone
    days = spark.createDataFrame([("2024-01-02",), ("2024-01-03",)], "date string")
    ingest.refresh_ranks(items([(3, "2024-01-02", None)]), path, days)
    assert {r["item_id"] for r in spark.read.parquet(path).collect()} == {1, 2}


def artwork_page(number, works):
    posts = [{"illust_id": i, "illust_page_count": str(n), "url": "https://x/thumb.jpg"} for i, n in works]
    return json.dumps({"page": number, "status": 200, "mode": "daily", "body": json.dumps({"contents": posts, "date": "20240105"})})


def test_artworks_give_an_item_per_page_and_rankings_are_upserted(spark, tmp_path):
    land, out = tmp_path / "land", str(tmp_path / "items")
    dead, rankings = str(tmp_path / "dead"), str(tmp_path / "rankings")
    land.mkdir()
    (land / "0.json").write_text(artwork_page(0, [(7, 3), (8, 1), (9, 0)]) + "\n" + artwork_page(1, [(7, 3)]))
    files = {7: ["7_p0.jpg", "7_p1.webp"], 8: ["8_p0.png"]}
    artworks = spark.createDataFrame(
        [(i, [{"urls": {"original": f"https://i/{n}"}} for n in names]) for i, names in files.items()],
        "post_id long, pages array<struct<urls:struct<original:string>>>",
    )
    hashes = spark.createDataFrame([(f"https://i/{n}", n, 10, "image/x") for v in files.values() for n in v], "url string, sha256 string, file_size long, content_type string")
    stored = spark.createDataFrame([("pixiv", 7, 0, "pixiv/7_p0.jpg", "7_p0.jpg")], "type string, post_id long, artwork_page int, key string, sha256 string")
    start = lambda: ingest.ingest_stream(spark, str(land), "pixiv", lambda: stored, hashes, out, str(tmp_path / "cp"), dead, artworks, rankings)
    assert ingest.ingest_all({"pixiv": start}) == {"pixiv": None}
    got = {r["key"]: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == ["pixiv/7_p1.webp", "pixiv/8_p0.png"]
    one = got["pixiv/7_p1.webp"]
    assert (one["artwork_page"], one["status"], one["date"], one["file_size"], one["width"]) == (1, "pending", "2024-01-05", 10, None)
    assert set(one["metadata"]) == {"pixiv", "pixivRanking"} and one["downloaded_at"] is not None
    lost = sorted((r["post_id"], r["artwork_page"]) for r in spark.read.parquet(f"{dead}/posts").collect())
    assert lost == [(7, 2), (9, 0)]
    (land / "1.json").write_text(artwork_page(5, [(8, 1)]))
    assert ingest.ingest_all({"pixiv": start}) == {"pixiv": None}
    places = {r["key"]: r["page"] for r in spark.read.parquet(f"{rankings}/pixiv").collect()}
    assert places == {"20240105-daily-7": 1, "20240105-daily-8": 5, "20240105-daily-9": 0}


def test_dates_of_every_provider(spark):
    row = spark.createDataFrame([("20240105", "2024-01-05", "1704466800", "Fri Jan 05 20:00:00 -0600 2024", "x")], "a string, b string, c string, d string, e string")
    date = lambda p, a, c: landing.post_date(p, F.col(a), F.col(c))
    got = row.select(date("pixiv", "a", "e"), date("danbooru", "b", "e"), date("sankaku", "e", "c"), date("gelbooru", "e", "d"), date("gelbooru", "e", "e"), date("danbooru", "e", "e"))
    assert tuple(got.first()) == ("2024-01-05", "2024-01-05", "2024-01-06", "2024-01-06", None, None)


def test_a_failed_item_is_offered_again_and_results_are_stored(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = [(1, "pending", "a"), (2, "pending", "b"), (3, "inferred", "c"), (4, "pending", None)]
    items = spark.createDataFrame([(i, s, p, {"old": i / 1.0}, f"2024-01-0{i}") for i, s, p in rows], "item_id long, status string, local_path string, inferences map<string,double>, date string")
    items.write.partitionBy("date").parquet(path)

    def job(fail):
        bad = F.col("item_id").isin(fail)
        result = F.when(~bad, F.create_map(F.lit("new"), F.lit(1.0)))
        return lambda todo: todo.select("item_id", F.when(bad, "error").otherwise("inferred").alias("status"), result.alias("inferences"))

    assert ingest.score_backlog(spark, path, job([2])).count() == 2
    read = lambda: {r["item_id"]: (r["status"], r["inferences"]) for r in spark.read.parquet(path).collect()}
    assert read() == {1: ("inferred", {"new": 1.0}), 2: ("error", {"old": 2.0}), 3: ("inferred", {"old": 3.0}), 4: ("pending", {"old": 4.0})}
    assert [r["item_id"] for r in ingest.score_backlog(spark, path, job([])).collect()] == [2]
    assert read()[2] == ("inferred", {"new": 1.0})
    assert ingest.score_backlog(spark, path, job([])).count() == 0 and len(read()) == 4


def test_streams_read_tables_that_are_folders_of_files(spark, tmp_path):
    from conftest import SMALL
    from vitrine.plans.q_streams import R

    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("m3_pending_stream", "m4_rank_cache"):
        rows = [R.queries[name](spark, folder) for folder in (SMALL, str(tmp_path))]
        assert rows[0].count() > 0
        assert sorted(map(tuple, rows[0].collect())) == sorted(map(tuple, rows[1].collect()))
