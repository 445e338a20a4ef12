"""Duplicates, unions and set operations; one popular file may make most rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.operators.scale import first_per_key, matching, skew_join


def dedupe_by_hash(items: DataFrame, hash: str = "sha256", at: str = "downloaded_at") -> DataFrame:
    """Adds canonical_key and outcome (unique, canonical, deduped, already_deduped).

    The oldest row of equal content wins, then the smallest key; the others become deduped
    and lose their path, which `freed_path` lists for whoever deletes the files. The winner is an aggregate joined back with salted hashes.
    """
    age = F.coalesce(F.col(at), F.timestamp_seconds(F.lit(0)))
    rows = items.where(F.col(hash).isNotNull())
    winners = rows.groupBy(hash).agg(
        F.min(F.struct(age.alias("at"), F.col("key"))).alias("_w"), F.count("*").alias("_n")
    ).where("_n > 1").select(hash, F.col("_w.key").alias("canonical_key"))
    out = skew_join(items, winners, [hash], "left", ["key"])
    winner = F.col("canonical_key")
    outcome = (
        F.when(winner.isNull(), "unique")
        .when(winner == F.col("key"), "canonical")
        .when(F.col("status") == V.DEDUPED, "already_deduped")
        .otherwise("deduped")
    )
    out = out.withColumn("outcome", outcome)
    changed = F.col("outcome") == "deduped"
    out = out.withColumn("status", F.when(changed, V.DEDUPED).otherwise(F.col("status")))
    if "local_path" in items.columns:
        out = out.withColumn("freed_path", F.when(changed, F.col("local_path")))
        out = out.withColumn("local_path", F.when(~changed, F.col("local_path")))
    return out


def flag_duplicates(new: DataFrame, items: DataFrame, hash: str = "sha256") -> DataFrame:
    """New rows become deduped without path if another key has their content, else pending.

    Within the batch the smallest key is the one that stays.
    """
    stored = matching(items.select(hash, "key"), new, [hash]).groupBy(hash).agg(
        F.min("key").alias("_low"), F.max("key").alias("_high")
    )
    batch = new.where(F.col(hash).isNotNull()).groupBy(hash).agg(F.min("key").alias("_first"))
    known = stored.join(batch, hash, "right")
    out = skew_join(new, known, [hash], "left", ["key"])
    key = F.col("key")
    other = (F.col("_low") != key) | (F.col("_high") != key) | (F.col("_first") < key)
    duplicate = F.coalesce(other, F.lit(False))
    return (
        out.withColumn("status", F.when(duplicate, V.DEDUPED).otherwise(V.PENDING))
        .withColumn("local_path", F.when(~duplicate, F.col("local_path")))
        .drop("_low", "_high", "_first")
    )


def dedupe_eval(evaluation: DataFrame, hash: str = "sha256", path: str = "file_path") -> DataFrame:
    """First path of every content hash; rows that could not be hashed are dropped."""
    rows = evaluation.where(F.col(hash).isNotNull() & (F.col(hash) != ""))
    return first_per_key(rows, [hash], [F.col(path)])


def union_manifest(
    archive: DataFrame, private_ids: DataFrame, public_ids: DataFrame, other: DataFrame, unlabeled: DataFrame
) -> DataFrame:
    """(item_id, label, file_path) of all sources; the first source wins an id.

    `archive` and `unlabeled` carry artwork_id: archived works take their label from the id
    lists, private before public, and works on a list are never unlabeled.
    """
    lists = private_ids.select("artwork_id", F.lit(0).alias("_p")).unionByName(
        public_ids.select("artwork_id", F.lit(1).alias("_p"))
    )
    marked = lists.groupBy("artwork_id").agg(F.min("_p").alias("_p"))
    positive = skew_join(archive, marked, ["artwork_id"], "inner", ["item_id"])
    label = F.when(F.col("_p") == 0, V.POSITIVE_LABELS[1]).otherwise(V.POSITIVE_LABELS[0])
    free = skew_join(unlabeled, marked.select("artwork_id"), ["artwork_id"], "left_anti", ["item_id"])
    pick = lambda df, n, l: df.select("item_id", l.alias("label"), "file_path", F.lit(n).alias("_src"))
    rows = (
        pick(positive, 0, label)
        .unionByName(pick(other, 1, F.lit(V.POSITIVE_LABELS[2])))
        .unionByName(pick(free, 2, F.lit(V.UNLABELED)))
    )
    return first_per_key(rows, ["item_id"], [F.col("_src"), F.col("file_path")]).drop("_src")


def id_difference(all_ids: DataFrame, stored: DataFrame) -> DataFrame:
    return all_ids.select("item_id").subtract(stored.select("item_id"))


def id_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("item_id").intersect(b.select("item_id"))


def toggle_category(df: DataFrame, category: Column, column: str = "categories") -> DataFrame:
    """Remove the category if present, else append it; the flag follows."""
    now = F.coalesce(F.col(column), F.array().cast("array<string>"))
    flipped = F.when(F.array_contains(now, category), F.array_remove(now, category)).otherwise(F.array_append(now, category))
    return df.withColumn(column, flipped).withColumn("isFavorited", F.size(column) > 0)


def migrate_favorites(items: DataFrame) -> DataFrame:
    """Side table (item_id, isFavorited, categories) of the favourites stored inside items."""
    chosen = items.where(F.col("favorites.isFavorited"))
    empty = F.array().cast("array<string>")
    return chosen.select("item_id", F.lit(True).alias("isFavorited"), F.coalesce("favorites.categories", empty).alias("categories"))


def label_upsert(labels: DataFrame, changes: DataFrame, order: list[Column]) -> DataFrame:
    """Apply the last change per path: a label sets the entry, a null label removes it."""
    from vitrine.operators.scale import last_per_key

    last = last_per_key(changes, ["path"], order).select("path", "label", "rating")
    kept = labels.join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.where("label IS NOT NULL"), allowMissingColumns=True)


def migrate_label_format(df: DataFrame, column: str = "label", ratable=None) -> DataFrame:
    """Text labels become (label, rating) structs; ratable labels start at rating 1."""
    rating = F.when(F.col(column).isin(ratable or V.RATABLE_LABELS), F.lit(1))
    return df.withColumn(column, F.struct(F.col(column).alias("label"), rating.alias("rating")))
