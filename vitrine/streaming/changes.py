"""Provider statistics kept from a stream of item changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def moderation_deltas(changes: DataFrame) -> DataFrame:
    """provider, count_delta, sum_delta of every effective change.

    `changes` carries `before` and `after`: maps provider to result, null if the item was
    not there. A result that appears counts +1, one that vanishes -1, a changed one 0.
    """
    empty = F.create_map().cast("map<string,double>")
    before, after = (F.coalesce(F.col(c).cast("map<string,double>"), empty) for c in ("before", "after"))
    rows = changes.select(
        *[c for c in changes.columns if c not in ("before", "after")],
        before.alias("_b"),
        after.alias("_a"),
        F.explode(F.array_union(F.map_keys(before), F.map_keys(after))).alias("provider"),
    )
    b, a = (F.try_element_at(c, F.col("provider")) for c in (F.col("_b"), F.col("_a")))
    deltas = rows.withColumn("count_delta", a.isNotNull().cast("long") - b.isNotNull().cast("long")).withColumn(
        "sum_delta", F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))
    )
    return deltas.where("count_delta <> 0 OR sum_delta <> 0").drop("_b", "_a")


def moderation_stats(changes: DataFrame, at: str = "changed_at") -> DataFrame:
    """provider, n, total, updated_at; works on a table and on a stream (update or complete mode).

    State is one row per provider, and tasks combine before the shuffle.
    """
    return moderation_deltas(changes).groupBy("provider").agg(
        F.sum("count_delta").alias("n"), F.sum("sum_delta").alias("total"), F.max(at).alias("updated_at")
    )


def moderation_stats_stream(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the whole statistics table in one of two folders in turn, with its batch number.

    A replayed batch overwrites its own folder, so at-least-once delivery of a batch changes
    nothing, and a crash while writing leaves the table of the batch before. Readers take the
    largest batch (`latest_stats`).
    """

    def write(stats: DataFrame, batch: int) -> None:
        numbered = stats.withColumn("batch", F.lit(batch).cast("long"))
        numbered.coalesce(1).write.mode("overwrite").parquet(f"{path}/slot={batch % 2}")

    writer = (
        moderation_stats(changes)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_stats(spark, path: str) -> DataFrame:
    tables = spark.read.parquet(path)
    return tables.where(F.col("batch") == tables.agg(F.max("batch")).scalar()).drop("batch", "slot")
