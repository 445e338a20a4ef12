"""Joins between items and their side tables; joins on possibly hot keys are salted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.scale import last_per_key, matching_if_small, seeded_order, skew_join, top_rows


def enrich(
    items: DataFrame, dims: DataFrame, on: str, newest: list[str], fill: list[str], spread: list[str], rename=None
) -> DataFrame:
    """Left join the newest dimension row per key; sizes in `fill` are 0 where absent.

    Dimension fields overlay item fields of the same name. `newest` lists the columns whose
    largest tuple is the newest row.
    """
    latest = last_per_key(dims, [on], [F.col(c) if isinstance(c, str) else c for c in newest])
    over = [c for c in latest.columns if c in items.columns and c != on]
    latest = latest.withColumnsRenamed({c: f"_d_{c}" for c in over})
    joined = skew_join(items, latest, [on], "left", spread)
    for c in over:
        joined = joined.withColumn(c, F.coalesce(f"_d_{c}", c)).drop(f"_d_{c}")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in fill})


def enrich_with_posts(items: DataFrame, rankings: DataFrame, pages: DataFrame, posts: DataFrame) -> DataFrame:
    """Width, height and ranking of every item.

    `rankings` (type, post_id, ranking_date, ...) overlay all providers; `pages` (post_id,
    pages array) give the size of one page of an artwork, `posts` (type, post_id,
    post_width, post_height) that of a single post. Anything absent is 0.
    """
    newest = last_per_key(rankings, ["type", "post_id"], [F.col("ranking_date")])
    sizes = posts.dropDuplicates(["type", "post_id"])
    art = pages.select("post_id", F.lit("pixiv").alias("type"), "pages").dropDuplicates(["post_id"])
    out = items
    for side in (newest, sizes, art):
        out = skew_join(out, side, ["type", "post_id"], "left", ["item_id"])
    page = F.get("pages", F.col("page"))
    size = lambda name: F.coalesce(
        F.when(F.col("type") == "pixiv", page[name]).otherwise(F.col(f"post_{name}")), F.lit(0)
    )
    return out.withColumn("width", size("width")).withColumn("height", size("height")).drop("pages", "post_width", "post_height")


def attach_favorites(page: DataFrame, favorites: DataFrame, key: str = "item_id") -> DataFrame:
    """Adds isFavorited and categories, false and empty where nothing is stored."""
    joined = page.join(favorites.select(key, "isFavorited", "categories"), key, "left")
    return joined.withColumn("isFavorited", F.coalesce("isFavorited", F.lit(False))).withColumn(
        "categories", F.coalesce("categories", F.array().cast("array<string>"))
    )


def backfill_source(
    items: DataFrame, mapping: DataFrame, type: str = "twitter", overwrite: bool = False, limit: int | None = None
) -> DataFrame:
    """Fill `source` from a media mapping (media_id, entry) and say what happened in `outcome`.

    Rows of another type come back unchanged without outcome. `limit` stops after so many
    updates, in item order.
    """
    from vitrine.functions.keys import media_id_from_key

    rows = items.withColumn("media_id", media_id_from_key(F.col("key")))
    joined = skew_join(rows, mapping, ["media_id"], "left", ["item_id"])
    open_row = F.col("source").isNull() | F.lit(overwrite)
    outcome = (
        F.when(F.col("type") != type, None)
        .when(~open_row | F.col("media_id").isNull(), "skipped")
        .when(F.col("entry").isNull(), "not_found")
        .otherwise("updated")
    )
    out = joined.withColumn("outcome", outcome)
    if limit is not None:
        chosen = top_rows(out.where("outcome = 'updated'").select("item_id"), [F.asc("item_id")], limit)
        out = out.join(chosen.withColumn("_in", F.lit(True)), "item_id", "left").withColumn(
            "outcome", F.when((F.col("outcome") == "updated") & F.col("_in").isNull(), None).otherwise(F.col("outcome"))
        ).drop("_in")
    return out.withColumn("source", F.when(F.col("outcome") == "updated", F.col("entry")).otherwise(F.col("source"))).drop(
        "entry", "media_id"
    )


def anti_existing(posts: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Posts not stored yet under the same key columns."""
    return posts.join(matching_if_small(items.select(*keys), posts, keys), keys, "left_anti")


def feature_coverage(manifest: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """item_id, feature of every manifest row a store lacks."""
    ids, out = manifest.select("item_id"), None
    for name, store in stores.items():
        gone = ids.join(store.select("item_id"), "item_id", "left_anti").withColumn("feature", F.lit(name))
        out = gone if out is None else out.unionByName(gone)
    return out


def covered_by_all(manifest: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """Manifest rows present in every store."""
    for store in stores.values():
        manifest = manifest.join(store.select("item_id"), "item_id", "left_semi")
    return manifest


def load_features(ids: DataFrame, store: DataFrame, dim: int) -> DataFrame:
    """Every requested row with its vector; a missing one is all zeros and marked `missing`."""
    joined = ids.join(store.select("item_id", "vec"), "item_id", "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return joined.withColumn("missing", F.col("vec").isNull()).withColumn("vec", F.coalesce("vec", zeros))


def remove_train_overlap(evaluation: DataFrame, train: DataFrame, hash: str = "sha256") -> DataFrame:
    """Evaluation rows whose content is not in the training set; rows without hash stay."""
    seen = train.where((F.col(hash) != "") & F.col(hash).isNotNull()).select(hash).distinct()
    return skew_join(evaluation, seen, [hash], "left_anti", ["item_id"])


def attach_documents(similar: DataFrame, items: DataFrame) -> DataFrame:
    """Ranked ids joined to their items; ids without item vanish, order is by rank."""
    return similar.join(items, "item_id").orderBy("rank")


def pending_downloads(listing: DataFrame, local: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n listed names that are not local, in an order shuffled by the seed."""
    todo = listing.join(local.select("name"), "name", "left_anti").withColumn("_h", seeded_order(seed, "name"))
    return top_rows(todo, [F.asc("_h"), F.asc("name")], n).drop("_h")


def without_annotation(items: DataFrame, need: str, lacking: str, n: int, column: str = "annotations") -> DataFrame:
    """First n items that have an entry of one provider and none of another."""
    has = lambda p: F.coalesce(F.map_contains_key(column, p), F.lit(False))
    return top_rows(items.where(has(need) & ~has(lacking)), [F.asc("item_id")], n)
