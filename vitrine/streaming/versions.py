"""Streams that remember what they saw: the last version of every item, and the files downloaded lately."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators.joins import anti_existing
from vitrine.operators.scale import last_per_key, matching
from vitrine.sources.sinks import drop_folder, exists
from vitrine.streaming.changes import moderation_deltas
from vitrine.streaming.ingest import POST_KEY

RESULTS = "map<string,double>"


def newest_versions(changes: DataFrame) -> DataFrame:
    """item_id, version, results (JSON) of the newest version of every item in `changes` (item_id, version, after).

    Of two rows with one version the greater text counts. Rows without an item id or version are left out.
    """
    rows = changes.where("item_id IS NOT NULL AND version IS NOT NULL").select(
        "item_id", F.col("version").cast("long").alias("version"), F.to_json(F.coalesce(F.col("after").cast(RESULTS), F.create_map().cast(RESULTS))).alias("results")
    )
    return last_per_key(rows, ["item_id"], [F.col("version"), F.col("results")])


def held_in(batch: int) -> list[int]:
    """The folders that hold the items of all batches before `batch`: one per binary digit of their number."""
    folders = []
    while batch > 0:
        folders.append(batch - 1)
        batch &= batch - 1
    return folders


def version_stats_stream(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the statistics of a stream of item versions (item_id, version, after) at `path`; `version_stats` adds them up.

    `after` maps provider to result, null for a deleted item. An item's newest version is kept under
    `path/items`, and only a newer one makes a difference to the statistics: repeated events count once
    and events may come in any order, also over restarts. Every batch joins its items to those kept and
    writes its sums and what changed into folders of its own, so a replayed batch replaces them.
    Folders of items are merged like the digits of a binary counter: there are no more of them than
    digits in the number of batches, and a row is written again as often at most.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark, items, held = rows.sparkSession, f"{path}/items", held_in(batch)
        # merged by the batch before, which is committed by now
        for gone in set(held_in(batch - 1)) - set(held):
            drop_folder(spark, f"{items}/batch={gone}")
        newest = newest_versions(rows).persist()
        stored = lambda folders: spark.read.schema(newest.schema).parquet(*[f"{items}/batch={b}" for b in folders])
        if held:
            before = last_per_key(matching(stored(held), newest, ["item_id"]), ["item_id"], [F.col("version"), F.col("results")])
        else:
            before = newest.where(F.lit(False))
        both = newest.join(before.withColumnsRenamed({"version": "_version", "results": "_results"}), "item_id", "left")
        newer = F.col("_version").isNull() | (F.struct("version", "results") > F.struct("_version", "_results"))
        fresh = both.where(newer).persist()
        pairs = fresh.select("version", F.from_json("_results", RESULTS).alias("before"), F.from_json("results", RESULTS).alias("after"))
        sums = moderation_deltas(pairs).groupBy("provider").agg(
            F.sum("count_delta").alias("n"), F.sum("sum_delta").alias("total"), F.max("version").alias("version")
        )
        sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/batch={batch}")
        kept, merged = fresh.select(*newest.columns), sorted(set(held) - set(held_in(batch + 1)))
        if merged:
            kept = last_per_key(kept.unionByName(stored(merged)), ["item_id"], [F.col("version"), F.col("results")])
        kept.write.mode("overwrite").parquet(f"{items}/batch={batch}")
        fresh.unpersist()
        newest.unpersist()

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def version_stats(spark: SparkSession, path: str) -> DataFrame:
    """provider, n, total, version (the newest that counted) over all batches; providers without items are left out."""
    sums = spark.read.schema("provider string, n long, total double, version long, batch long").parquet(f"{path}/sums")
    return sums.groupBy("provider").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("version").alias("version")).where("n <> 0")


def first_downloads(downloads: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first row of every file (type, post_id, artwork_page) in a stream of downloads, by `downloaded_at`.

    Files are remembered until the newest download is `delay` ahead of their own, so the state holds
    the files of about that time and does not grow with the stream. Rows that come later than that
    are dropped. Rows without a download time are left out.
    """
    rows = downloads if "artwork_page" in downloads.columns else downloads.withColumn("artwork_page", F.lit(0))
    rows = rows.withColumn("downloaded_at", F.col("downloaded_at").cast("timestamp"))
    return rows.where("downloaded_at IS NOT NULL").withWatermark("downloaded_at", delay).dropDuplicatesWithinWatermark(POST_KEY)


def downloads_stream(
    spark: SparkSession, downloads: DataFrame, target: str, checkpoint: str, delay: str = "1 day", available_now: bool = True
) -> StreamingQuery:
    """Append every file of a stream of downloads once, each batch to `target/batch=<id>`.

    Repeats within `delay` are told by the stream's own state; a file that comes again later is
    found among those written before, by a join that reads their keys alone. A replayed batch
    replaces its folder, so a restart changes nothing.
    """

    def write(rows: DataFrame, batch: int) -> None:
        if exists(spark, target):
            earlier = spark.read.schema("type string, post_id long, artwork_page int, batch long").parquet(target)
            rows = anti_existing(rows, earlier.where(F.col("batch") != batch), POST_KEY)
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    writer = first_downloads(downloads, delay).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
