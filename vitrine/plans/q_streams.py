"""Queries that run a stream over the given tables to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.functions.udfs import byte_histogram
from vitrine.learning.inference import inference_job
from vitrine.learning.models import LinearScorer, Member
from vitrine.operators.filters import filter_items
from vitrine.operators.scale import shared_folder
from vitrine.plans.fixtures import ITEMS, Registry, items, table
from vitrine.plans.q_ranking import RANKED
from vitrine.plans.q_sources import PLACED, artworks, landed, landed_as
from vitrine.streaming import changes, ingest, moved_ranks, versions

R = Registry()


def folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_of(spark, d, name):
    """A given table, one file or a folder of them, as a file stream.

    A stream takes a single file only by a pattern; this one matches nothing but the table.
    """
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def change_events(events):
    """Two changes per event: an item appears with one result, then its results are replaced."""
    k = F.expr("CAST(get_json_object(props, '$.k') AS INT)")
    first = F.map_filter(
        F.create_map(F.lit("minicpm"), F.floor(k / 10).cast("double")), lambda n, _: F.col("event_type") != "view"
    )
    second = F.map_filter(
        F.create_map(F.lit("minicpm"), F.floor("value").cast("double"), F.lit("joycaption"), F.floor("value").cast("double") + 1),
        lambda n, _: F.when(n == "minicpm", F.col("event_type") != "error").otherwise(F.col("event_type") == "click"),
    )
    none = F.lit(None).cast("map<string,double>")
    pair = lambda b, a: F.struct(b.alias("before"), a.alias("after"))
    rows = events.select("event_id", F.col("ts").alias("changed_at"), F.explode(F.array(pair(none, first), pair(first, second))).alias("c"))
    return rows.select("event_id", "changed_at", "c.before", "c.after")


FINAL = """
SELECT provider, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM (
  SELECT 'minicpm' AS provider, floor(value) AS v FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'joycaption', floor(value) + 1 FROM events WHERE event_type = 'click') GROUP BY 1"""


@R.add("m1_moderation_stats", FINAL)
def _(spark, d):
    return changes.moderation_stats(change_events(table(spark, d, "events"))).drop("updated_at")


@R.add("m1_moderation_stats_stream", FINAL)
def _(spark, d):
    out = folder(spark)
    query = changes.moderation_stats_stream(change_events(stream_of(spark, d, "events")), f"{out}/stats", f"{out}/checkpoint")
    query.awaitTermination()
    return changes.latest_stats(spark, f"{out}/stats").drop("updated_at")


@R.add("m1_item_versions_stream", FINAL)
def _(spark, d):
    out = folder(spark)
    pair = change_events(stream_of(spark, d, "events")).select("event_id", "before", "after", F.col("before").isNull().alias("first"))
    # every version twice, the newer one first
    twice = F.explode(F.expr("CASE WHEN first THEN array(2L, 1L) ELSE array(0L, 3L) END")).alias("turn")
    rows = pair.select(F.col("event_id").alias("item_id"), F.when(F.col("first"), 1).otherwise(2).cast("long").alias("version"), "after", twice)
    versions.version_stats_stream(rows.drop("turn"), f"{out}/sums", f"{out}/checkpoint").awaitTermination()
    return versions.version_stats(spark, f"{out}/sums").drop("version")


@R.add("m2_first_downloads", """
SELECT DISTINCT event_type AS type, user_id AS post_id FROM events""")
def _(spark, d):
    out = folder(spark)
    rows = table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("post_id"), F.col("ts").alias("downloaded_at"))
    # pages land by day of the month in five turns, the first turn once more at the end, read after a restart
    for turns in ((0, 1, 2), (3, 4, 0)):
        for turn in turns:
            rows.where(F.expr(f"least((dayofmonth(downloaded_at) - 1) div 6, 4) = {turn}")).write.mode("append").parquet(f"{out}/landing")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{out}/landing")
        versions.downloads_stream(spark, stream, f"{out}/items", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("type string, post_id long").parquet(f"{out}/items").select("type", "post_id")


@R.add("m2_ingest_stream", """
WITH p AS (SELECT event_id, 'danbooru/' || event_id || '.jpg' AS key, sha256(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS sha,
    first_value(event_type) OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS f FROM events),
s AS (SELECT DISTINCT sha FROM p WHERE event_id IN (SELECT doc_id FROM labels)),
n AS (SELECT event_id, key, sha, row_number() OVER (PARTITION BY sha ORDER BY key) AS r FROM p WHERE f <> 'error' AND event_id NOT IN (SELECT doc_id FROM labels))
SELECT event_id AS post_id, key, CASE WHEN r > 1 OR sha IN (SELECT sha FROM s) THEN 'deduped' ELSE 'pending' END AS status FROM n""")
def _(spark, d):
    out = folder(spark)
    landed(spark, d).write.json(f"{out}/landing")
    digest = F.sha2(F.round(F.col("value") * 100).cast("long").cast("string"), 256).alias("sha256")
    url = F.concat(F.lit("https://cdn.example/"), "event_type", F.lit("/"), "event_id", F.lit(".jpg"))
    hashes = table(spark, d, "events").select(url.alias("url"), "event_id", digest)
    known = hashes.join(table(spark, d, "labels"), F.col("event_id") == F.col("doc_id")).select(
        F.lit("danbooru").alias("type"), F.col("event_id").alias("post_id"), F.concat(F.lit("danbooru/"), "event_id", F.lit(".jpg")).alias("key"), "sha256"
    )
    ingest.ingest_all(
        {"danbooru": lambda: ingest.ingest_stream(spark, f"{out}/landing", "danbooru", lambda: known, hashes, f"{out}/items", f"{out}/checkpoint")}
    )
    return spark.read.parquet(f"{out}/items").select("post_id", "key", "status")


@R.add("m2_ingest_artworks", f"""
WITH {PLACED}, n AS (SELECT event_id, page, 'pixiv/' || event_id || '_p0.png' AS key, sha256(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS sha
  FROM p WHERE f <> 'error' AND event_type <> 'click')
SELECT event_id AS post_id, key, strftime(DATE '2024-01-01' + CAST(page % 28 AS INT), '%Y-%m-%d') AS date,
       CASE WHEN row_number() OVER (PARTITION BY sha ORDER BY key) > 1 THEN 'deduped' ELSE 'pending' END AS status FROM n""")
def _(spark, d):
    out = folder(spark)
    landed_as(spark, d, "pixiv").write.json(f"{out}/landing")
    digest = F.sha2(F.round(F.col("value") * 100).cast("long").cast("string"), 256).alias("sha256")
    url = F.concat(F.lit("https://i.example/"), "event_id", F.lit("_p0.png")).alias("url")
    hashes = table(spark, d, "events").select(url, digest)
    none = spark.createDataFrame([], "type string, post_id long, artwork_page int, key string, sha256 string")
    start = lambda works: lambda: ingest.ingest_stream(
        spark, f"{out}/landing", "pixiv", lambda: none, hashes, f"{out}/items", f"{out}/checkpoint-{works is None}", f"{out}/dead", works, f"{out}/rankings"
    )
    # a source whose artworks are not known fails, the other goes on
    outcome = ingest.ingest_all({"failing": start(None), "pixiv": start(artworks(spark, d))})
    if outcome["pixiv"] is not None or outcome["failing"] is None:
        raise RuntimeError(str(outcome))
    return spark.read.schema("post_id long, key string, date string, status string").parquet(f"{out}/items").select("post_id", "key", "date", "status")


@R.add("m2_rankings", f"""
WITH {PLACED} SELECT strftime(DATE '2024-01-01' + CAST(page % 28 AS INT), '%Y%m%d') || '-daily-' || event_id AS key, page, i AS "index" FROM p WHERE f <> 'error'""")
def _(spark, d):
    return ingest.ranking_entries(landed_as(spark, d, "pixiv"), "pixiv").select("key", "page", "index")


@R.add("m3_score_backlog", """
SELECT doc_id AS item_id, CASE WHEN text IS NULL OR (lang = 'de' AND doc_id % 10 = 0) THEN 'error' ELSE 'inferred' END AS status,
       text IS NOT NULL AND NOT coalesce(lang = 'de' AND doc_id % 10 = 0, false) AS scored FROM documents""")
def _(spark, d):
    out = folder(spark)
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("/media/"), "doc_id").alias("path")
    scorer = LinearScorer("flat", "hist", "centroid", [Member([0.1] * 16, 0.0)])

    def job(readable):
        files = docs.select(path, F.when(F.expr(readable), F.encode("text", "UTF-8")).alias("content"))
        return lambda todo: inference_job(todo, files, byte_histogram, {"vec": "array<float>"}, [scorer], {"hist": "vec"})

    date = F.expr("date_format(date_add(DATE'2024-01-01', CAST(doc_id % 7 AS INT)), 'yyyy-MM-dd')").alias("date")
    empty = F.lit(None).cast("map<string,map<string,double>>").alias("inferences")
    items = docs.select(F.col("doc_id").alias("item_id"), F.lit("pending").alias("status"), path.alias("local_path"), empty, date)
    items.write.partitionBy("date").parquet(f"{out}/items")
    # what fails in the first run is offered again in the second
    for readable in ("coalesce(lang, '') <> 'de'", "coalesce(lang, '') <> 'de' OR doc_id % 10 <> 0"):
        ingest.score_backlog(spark, f"{out}/items", job(readable))
    return spark.read.parquet(f"{out}/items").select("item_id", "status", F.col("inferences").isNotNull().alias("scored"))


@R.add("m3_pending_stream", """
SELECT doc_id AS item_id, CASE WHEN lang = 'de' THEN 'error' ELSE 'inferred' END AS status FROM documents WHERE source IN ('src1', 'src2')""")
def _(spark, d):
    out = folder(spark)
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("/media/"), "doc_id")
    files = docs.select(path.alias("path"), F.when(F.col("lang") != "de", F.encode("text", "UTF-8")).alias("content"))
    scorer = LinearScorer("flat", "hist", "centroid", [Member([0.1] * 16, 0.0)])

    def process(batch, number):
        done = inference_job(batch, files, byte_histogram, {"vec": "array<float>"}, [scorer], {"hist": "vec"})
        done.select("item_id", "status").write.mode("overwrite").parquet(f"{out}/items/batch={number}")

    status = F.when(F.col("source").isin("src1"), "pending").when(F.col("source") == "src2", "error").otherwise("inferred")
    backlog = stream_of(spark, d, "documents").select(F.col("doc_id").alias("item_id"), status.alias("status"), path.alias("local_path"))
    ingest.pending_stream(backlog, process, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/items").select("item_id", "status")


@R.add("m4_rank_cache", f"""
WITH {ITEMS}, {RANKED} SELECT item_id, date, model, field, rank, total FROM ranked""")
def _(spark, d):
    out = folder(spark)
    date = F.expr("date_format(date_add(DATE'2024-01-01', CAST(doc_id % 60 AS INT)), 'yyyy-MM-dd')")
    changed = stream_of(spark, d, "documents").select(date.alias("date"))
    ingest.rank_cache_stream(changed, lambda: items(spark, d), f"{out}/ranks", f"{out}/checkpoint").awaitTermination()
    ranks = spark.read.schema("item_id long, model string, field string, value double, rank long, total long, date string").parquet(f"{out}/ranks")
    return ranks.select("item_id", "date", "model", "field", "rank", "total")


@R.add("m4_moved_ranks", f"""
WITH {ITEMS}, {RANKED} SELECT item_id, date, model, field, rank, total FROM ranked""")
def _(spark, d):
    out = folder(spark)
    right = moved_ranks.first_scores(filter_items(items(spark, d)))
    # a third comes with a wrong score, which the second batch mends
    wrong = F.when(F.col("item_id") % 3 == 0, F.col("after") * 3 - 0.1).otherwise(F.col("after"))
    moved_ranks.move_scores(right.withColumn("after", wrong), out, 0.25)
    mended = right.where("item_id % 3 = 0").withColumns({"before": wrong, "version": F.lit(1).cast("long")})
    moved_ranks.move_scores(mended, out, 0.25)
    return moved_ranks.moved_ranks(spark, out).select("item_id", "date", "model", "field", "rank", "total")
