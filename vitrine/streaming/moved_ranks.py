"""Ranks kept while scores change: places within score bands are stored, and only the bands a change touches are read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.operators.ranking import explode_fields
from vitrine.operators.scale import broadcast_if_small, last_per_key, null_safe_join, number_rows, stored
from vitrine.sources.sinks import exists, write_partitions

RANKED = ["date", "model", "field"]
SCORES = "item_id {id}, model string, field string, value double, place long, date string, band int"
COUNTS = "model string, field string, n long, date string, band int"
# Bands end here; what lies beyond belongs to the last one.
EDGE = 100_000
# So many touched bands are named to the scan; more are left to a join.
NAMED = 2000


def band(value: Column, width: float) -> Column:
    """Number of the band a score lies in; rising with the score, NaN above all."""
    number = F.greatest(F.least(F.floor(value / width), F.lit(EDGE)), F.lit(-EDGE))
    return F.when(F.isnan(value), F.lit(EDGE + 1)).otherwise(number).cast("int")


def first_scores(items: DataFrame) -> DataFrame:
    """Items as changes from nothing: item_id, date, model, field, before, after, version."""
    rows = explode_fields(items.where("date IS NOT NULL"))
    return rows.select("item_id", *RANKED, F.lit(None).cast("double").alias("before"), F.col("value").alias("after"), F.lit(0).cast("long").alias("version"))


def _inside(spark: SparkSession, path: str, touched: DataFrame, item: str) -> DataFrame:
    """Stored scores of the touched bands; only their folders are listed if they are few."""
    scores = spark.read.schema(SCORES.format(id=item)).parquet(f"{path}/scores")
    counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")
    named = touched.limit(NAMED + 1).collect()
    if len(named) <= NAMED:
        inside = F.col("date").isin(sorted({r["date"] for r in named})) & F.col("band").isin(sorted({r["band"] for r in named}))
        scores, counts = scores.where(inside), counts.where(inside)
    near = scores.join(broadcast_if_small(touched), ["date", "band"])
    # folders of bands that lost their last score are still there
    return near.join(broadcast_if_small(counts.where("n > 0").select(*RANKED, "band")), [*RANKED, "band"], "left_semi")


def move_scores(changes: DataFrame, path: str, width: float = 0.05) -> None:
    """Take changed scores into the rank table at `path`.

    `changes` (item_id, date, model, field, before, after, version) say from which score to which
    an item of a date moved: `before` is null for a new score, `after` for one that goes. Of several
    changes of one score the last version counts. Scores are kept by date and band of `width`,
    with their place inside the band; a change reads and writes the bands it leaves and enters and
    no other, and the ranks between follow from the bands' counts. Running a batch again, after a
    failure or twice, gives the same table. Rows without date, model, field or item are left out.
    """
    spark = changes.sparkSession
    rows = changes.dropna(subset=["item_id", *RANKED]).withColumns({"_from": band(F.col("before"), width), "_to": band(F.col("after"), width)})
    rows = stored(rows.select("item_id", *RANKED, "after", "version", "_from", "_to"))
    touched = stored(rows.select("date", F.explode(F.array("_from", "_to")).alias("band")).where("band IS NOT NULL").distinct())
    last = stored(last_per_key(rows, ["item_id", *RANKED], [F.col("version")]))
    moved = last.where("after IS NOT NULL").select("item_id", *RANKED, F.col("after").alias("value"), F.col("_to").alias("band"))
    if exists(spark, f"{path}/scores"):
        item = dict(changes.dtypes)["item_id"]
        old = _inside(spark, path, touched, item).join(last.select("item_id", *RANKED), ["item_id", *RANKED], "left_anti")
        moved = moved.unionByName(old.select(*moved.columns))
    placed = number_rows(moved, [*RANKED, "band"], [F.desc("value"), F.asc("item_id")], "place")
    placed = stored(placed.select("item_id", "model", "field", "value", "place", "date", "band"))
    counts = placed.groupBy("model", "field", "date", "band").agg(F.count("*").alias("n"))
    # a band without any score left still gets its counts replaced
    none = touched.select(*[F.lit(None).cast("string").alias(c) for c in ("model", "field")], "date", "band", F.lit(0).cast("long").alias("n"))
    counts = stored(counts.unionByName(none))
    write_partitions(placed, f"{path}/scores", ["date", "band"])
    write_partitions(counts, f"{path}/counts", ["date", "band"])


def moved_ranks(spark: SparkSession, path: str, date: str | None = None, item: str = "long") -> DataFrame:
    """item_id, date, model, field, value, rank, total of all dates or one: places within bands after all the bands above."""
    scores = spark.read.schema(SCORES.format(id=item)).parquet(f"{path}/scores")
    counts = spark.read.schema(COUNTS).parquet(f"{path}/counts").where("n > 0")
    if date is not None:
        scores, counts = scores.where(F.col("date") == date), counts.where(F.col("date") == date)
    whole = Window.partitionBy(*RANKED)
    above = whole.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per band of a field of a date
    offsets = counts.select(*RANKED, "band", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_above"), F.sum("n").over(whole).alias("total"))
    placed = null_safe_join(scores, broadcast_if_small(offsets), [*RANKED, "band"], "inner")
    return placed.select("item_id", *RANKED, "value", (F.col("_above") + F.col("place")).alias("rank"), "total")
