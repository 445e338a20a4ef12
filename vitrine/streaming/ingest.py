"""Incremental jobs: landed posts, pending items and the rank table."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine import values as V
from vitrine.functions.keys import item_key, ranking_key
from vitrine.operators.dedup import flag_duplicates
from vitrine.operators.filters import pending
from vitrine.operators.joins import anti_existing
from vitrine.operators.ranking import score_ranks
from vitrine.operators.scale import broadcast_if_small, first_per_key, last_per_key, matching_if_small
from vitrine.operators.scale import stored as written
from vitrine.sources.landing import PAGE_SCHEMA, PAGED, RANKED, expand_pages, post_date, posts_of_pages, rejected_pages
from vitrine.sources.sinks import drop_folder, upsert, upsert_partitions, write_partitions

log = logging.getLogger(__name__)


POST_KEY = ["type", "post_id", "artwork_page"]
# What a download tells about a file, besides its hash.
FACTS = {"content_type": "string", "downloaded_at": "timestamp", "file_size": "long", "width": "int", "height": "int"}


def check_source(provider: str, artworks: DataFrame | None) -> None:
    if provider in PAGED and artworks is None:
        raise ValueError(f"posts of {provider} have several files: artworks must name them")


def keyed_posts(pages: DataFrame, provider: str, artworks: DataFrame | None = None) -> DataFrame:
    """Files of landed posts with key, date and artwork_page, each once; the key is null where none is allowed."""
    return keyed(posts_of_pages(pages, provider), provider, artworks)


def keyed(posts: DataFrame, provider: str, artworks: DataFrame | None = None) -> DataFrame:
    """`keyed_posts` of posts that were read from their pages already."""
    check_source(provider, artworks)
    posts = first_per_key(posts, ["type", "post_id"], [F.col("page"), F.col("index")])
    if provider in PAGED:
        posts = expand_pages(written(posts), artworks)
    else:
        posts = posts.withColumn("artwork_page", F.lit(0))
    key, date = item_key(provider, F.col("post_id"), F.col("url")), post_date(provider, F.col("asked"), F.col("created_at"))
    return written(posts.withColumns({"key": key, "date": date}))


def fresh_posts(pages: DataFrame, provider: str, stored: DataFrame, artworks: DataFrame | None = None) -> DataFrame:
    """Files of landed pages that have a key and are not stored yet, each once."""
    return not_stored(keyed_posts(pages, provider, artworks), stored)


def not_stored(posts: DataFrame, stored: DataFrame) -> DataFrame:
    if "artwork_page" not in stored.columns:
        stored = stored.withColumn("artwork_page", F.lit(0))
    return anti_existing(posts.where("key IS NOT NULL"), stored, POST_KEY)


def hashed_items(fresh: DataFrame, stored: DataFrame, hashes: DataFrame) -> DataFrame:
    """Fresh posts as whole items: checked for equal content, pending or deduped; those without a hash are left out.

    `hashes` holds url and sha256, and any of FACTS; without a download time it is now.
    """
    known = matching_if_small(hashes.select("url", "sha256", *[c for c in FACTS if c in hashes.columns]), fresh, ["url"])
    found = fresh.join(known, "url")
    for c, kind in FACTS.items():
        found = found if c in found.columns else found.withColumn(c, F.lit(None).cast(kind))
    ranking = F.to_json(F.struct("mode", "date", "page", "index"))
    items = found.select(
        *POST_KEY, "key", "date", F.col("url").alias("original_url"), "sha256", *[c for c in FACTS if c != "downloaded_at"],
        F.coalesce("downloaded_at", F.current_timestamp()).alias("downloaded_at"),
        F.concat(F.lit("/media/"), "key").alias("local_path"),
        F.create_map().cast("map<string,map<string,double>>").alias("inferences"),
        F.create_map(F.col("type"), F.col("post"), F.concat("type", F.lit("Ranking")), ranking).alias("metadata"),
    )
    return flag_duplicates(written(items), stored)


def dead_posts(posts: DataFrame, fresh: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files that cannot become items: without an allowed key, or of unknown content."""
    known = matching_if_small(hashes.where("sha256 IS NOT NULL").select("url"), fresh, ["url"])
    lost = fresh.join(known, "url", "left_anti").unionByName(posts.where("key IS NULL"))
    return lost.select(*POST_KEY, "key", "url")


def ranking_entries(pages: DataFrame, provider: str) -> DataFrame:
    """key, type, post_id, date, mode, page, index, post: every place of a post in what landed.

    Rankings count a post once per day and mode, other listings once; the last place wins.
    """
    return last_per_key(places(posts_of_pages(pages, provider), provider), ["key"], [F.col("page"), F.col("index")])


def places(posts: DataFrame, provider: str) -> DataFrame:
    """Rows of `ranking_entries`, with every place of a key."""
    own = F.col("post_id").cast("string")
    key = ranking_key(F.col("asked"), F.col("mode"), F.col("post_id")) if provider in RANKED else own
    rows = posts.select(
        key.alias("key"), "type", "post_id", post_date(provider, F.col("asked"), F.col("created_at")).alias("date"), "mode", "page", "index", "post"
    )
    return rows.where("post_id IS NOT NULL")


def new_items(
    pages: DataFrame, provider: str, stored: DataFrame, hashes: DataFrame, artworks: DataFrame | None = None
) -> DataFrame:
    """Items of landed pages that are not stored: keyed, checked for equal content, pending or deduped.

    `stored` are the items so far (type, post_id, artwork_page, key, sha256). The posts, and then
    the new ones with their hashes, are written, as several joins start from them.
    """
    return hashed_items(fresh_posts(pages, provider, stored, artworks), stored, hashes)


def ingest_stream(
    spark: SparkSession,
    landing: str,
    provider: str,
    read_stored: Callable[[], DataFrame],
    hashes: DataFrame,
    target: str,
    checkpoint: str,
    dead: str | None = None,
    artworks: DataFrame | None = None,
    rankings: str | None = None,
) -> StreamingQuery:
    """Take the pages that landed since the last run; a file is read once, also after a restart.

    Each batch writes `target/type=<provider>/batch=<id>`, so a replay replaces itself. The
    stored items are asked for anew in every batch. As a file is never read again, what cannot
    become an item is kept: posts without a key or a hash under `dead/posts`, rejected pages under
    `dead/pages`, in the same partitions. With `rankings` the places of all posts are upserted
    into that folder of the provider, by date.
    """
    check_source(provider, artworks)

    def write(pages: DataFrame, batch: int) -> None:
        stored = read_stored()
        if "batch" in stored.columns:
            # a replayed batch must not find its own earlier output
            stored = stored.where((F.col("type") != provider) | (F.col("batch") != batch) | F.col("batch").isNull())
        at = f"type={provider}/batch={batch}"
        found = written(posts_of_pages(pages, provider))
        if rankings:
            # the last place of a key is picked there
            upsert_partitions(places(found, provider), f"{rankings}/{provider}", ["key"], ["date"], [F.col("page"), F.col("index")])
        posts = keyed(found, provider, artworks)
        fresh = written(not_stored(posts, stored))
        if dead:
            dead_posts(posts, fresh, hashes).drop("type").write.mode("overwrite").parquet(f"{dead}/posts/{at}")
            rejected_pages(pages, provider).write.mode("overwrite").parquet(f"{dead}/pages/{at}")
        hashed_items(fresh, stored, hashes).drop("type").write.mode("overwrite").parquet(f"{target}/{at}")

    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .json(landing)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def ingest_all(start: dict[str, Callable[[], StreamingQuery]]) -> dict[str, str | None]:
    """Run one query per source at the same time; a failing source does not stop the others."""
    running, outcome = {}, {}
    for source, begin in start.items():
        try:
            running[source] = begin()
        except Exception as e:  # one source must not stop the rest
            outcome[source] = str(e)
    for source, query in running.items():
        try:
            query.awaitTermination()
            outcome[source] = None
        except Exception as e:
            log.warning("source %s failed: %s", source, e)
            outcome[source] = str(e)
    return outcome


def pending_stream(items: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand the pending and failed items of a stream to `process`, batch by batch."""
    return (
        items.where(F.col("status").isin(V.PENDING, V.ERROR))
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(process)
        .start()
    )


def score_backlog(spark: SparkSession, path: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One run over the stored items that are pending or failed before; returns what `job` gave.

    `path` holds items by date. `job` takes the waiting ones and returns item_id, status and any
    fields to set; they are merged into the stored items, null fields leaving what is there, and
    only the touched dates are written again. An item that fails stays for the next run.
    """
    todo = written(pending(spark.read.parquet(path)))
    done = written(job(todo))
    known = [c for c in done.columns if c in todo.columns]
    merged = upsert(todo, done.select(*known).join(todo.select("item_id"), "item_id", "left_semi"), ["item_id"])
    upsert_partitions(merged.select(*todo.columns), path, ["item_id"], ["date"], [F.col("status")])
    return done


def refresh_ranks(items: DataFrame, path: str, dates: DataFrame | None = None) -> None:
    """Write the rank table by date; only dates in `items` are replaced.

    `dates` names the dates that `items` is meant to cover: one without a ranked item left loses
    its ranks. Readers see ranks no older than the last refresh, so the trigger interval bounds
    staleness.
    """
    ranks = written(score_ranks(items))
    write_partitions(ranks, path, ["date"])
    if dates is not None:
        # one row per calendar day
        for row in dates.where("date IS NOT NULL").distinct().join(ranks.select("date"), "date", "left_anti").collect():
            drop_folder(items.sparkSession, f"{path}/date={row['date']}")


def rank_cache_stream(changed: DataFrame, read_items: Callable[[], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Refresh the ranks of every date that a batch of changed items touches."""

    def refresh(batch: DataFrame, _: int) -> None:
        dates = written(batch.select("date").distinct())
        refresh_ranks(read_items().join(broadcast_if_small(dates), "date", "left_semi"), path, dates)

    return (
        changed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(refresh).start()
    )
