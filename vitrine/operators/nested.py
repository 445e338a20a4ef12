"""Maps, arrays and structs: tags, tiers, axes and provider metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.functions.keys import media_id_from_url
from vitrine.functions.vectors import take_indices
from vitrine.operators.scale import broadcast_if_small, last_per_key


def media_mapping(entries: DataFrame, order: list[str] = ("created_at", "id_str")) -> DataFrame:
    """One row per media id of flattened archive entries; the last entry wins."""
    media = F.when(F.size("extended_media") > 0, F.col("extended_media")).otherwise(F.col("media"))
    some = lambda c: F.nullif(c, F.lit(""))
    blank = F.lit("")
    user = F.when(
        F.col("user").isNotNull(),
        F.struct(*[F.coalesce(F.col(f"user.{c}"), blank).alias(c) for c in ("screen_name", "name", "id_str")]),
    ).when(
        some(F.col("user_id_str")).isNotNull(),
        F.struct(blank.alias("screen_name"), blank.alias("name"), F.col("user_id_str").alias("id_str")),
    )
    rows = (
        entries.where(some(F.col("id_str")).isNotNull())
        .select("*", F.posexplode(media).alias("_pos", "_m"))
        .withColumn("media_url", F.coalesce(some(F.col("_m.media_url_https")), some(F.col("_m.media_url"))))
        .withColumn("media_id", media_id_from_url(F.col("media_url")))
        .where("media_id IS NOT NULL")
    )
    shaped = rows.select(
        "media_id",
        "id_str",
        F.coalesce(some(F.col("full_text")), F.col("text"), blank).alias("text"),
        F.coalesce("created_at", blank).alias("created_at"),
        "media_url",
        user.alias("user"),
        F.when(F.col("is_quote_status"), True).alias("is_quote_status"),
        "retweeted_status",
        "_pos",
    )
    return last_per_key(shaped, ["media_id"], [*[F.col(c) for c in order], F.col("_pos")]).drop("_pos")


def _bounds(which: dict[str, float]) -> Column:
    """Probability a tag of each kind must reach."""
    column = F.lit(None).cast("double")
    for kind, bound in which.items():
        column = F.when(F.col("kind") == kind, bound).otherwise(column)
    return column


def tag_probs(df: DataFrame, vocabulary: DataFrame, probs: str = "probs") -> DataFrame:
    """item_id, idx, tag, kind, prob of the probabilities worth keeping raw.

    `vocabulary` is (idx, tag, kind). Small ones cut the vector before the join, so only
    likely tags become rows.
    """
    least = min(V.RAW_BOUNDS["feature"], V.TIER_BOUNDS["feature"]["low"], *V.RAW_BOUNDS.values())
    likely = df.select("item_id", F.posexplode(probs).alias("idx", "prob")).where(F.col("prob") >= least)
    joined = likely.join(broadcast_if_small(vocabulary), "idx")
    return joined.where(F.col("prob") >= _bounds(V.RAW_BOUNDS)).select("item_id", "idx", "tag", "kind", "prob")


def tier_tags(df: DataFrame, vocabulary: DataFrame, probs: str = "probs") -> DataFrame:
    """item_id, tier, category, tag, prob; tiers are cumulative, bounds inclusive."""
    rows = tag_probs(df, vocabulary, probs)
    tiers = [
        F.when(F.col("prob") >= _bounds({k: b[t] for k, b in V.TIER_BOUNDS.items()}), F.lit(t)) for t in V.TIERS
    ]
    return rows.select("item_id", F.explode(F.array_compact(F.array(*tiers))).alias("tier"), F.col("kind").alias("category"), "tag", "prob")


def derive_ip(tiered: DataFrame, char_ip: DataFrame) -> DataFrame:
    """item_id, tier, ip: the distinct IPs of an item's characters."""
    characters = tiered.where("category = 'character'").select("item_id", "tier", "tag")
    return characters.join(broadcast_if_small(char_ip), "tag").select("item_id", "tier", "ip").distinct()


def ip_lists(tiered: DataFrame, char_ip: DataFrame) -> DataFrame:
    """The IPs of an item and tier as one sorted array (an item has few tags)."""
    return derive_ip(tiered, char_ip).groupBy("item_id", "tier").agg(F.array_sort(F.collect_list("ip")).alias("ips"))


def _position(column: str, names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))


def ordered_tags(tiered: DataFrame, ips: DataFrame, tier: str = "low") -> DataFrame:
    """Tags of each item down to a tier: a name keeps its first place, position is the shown order.

    Shown by category, then tier, then name; an IP has no probability.
    """
    all_tags = tiered.select("item_id", "tier", "category", "tag", "prob").unionByName(
        ips.select("item_id", "tier", F.lit("ip").alias("category"), F.col("ip").alias("tag"), F.lit(None).cast("double").alias("prob"))
    )
    wanted = all_tags.where(F.col("tier").isin(V.TIERS[: V.TIERS.index(tier) + 1]))
    t, c = _position("tier", V.TIERS), _position("category", V.TAG_CATEGORY_ORDER)
    # one item holds at most the vocabulary, so its list is bounded and one shuffle is enough
    entry = F.struct("tag", t.alias("t"), c.alias("c"), "category", "tier", "prob")
    lists = wanted.groupBy("item_id").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    is_first = lambda e, i: (i == 0) | (F.get("_l", i - 1)["tag"] != e["tag"])
    shown = F.array_sort(
        F.transform(F.filter("_l", is_first), lambda e: F.struct(e["c"].alias("c"), e["t"].alias("t"), e["tag"].alias("tag"), e.alias("e")))
    )
    return lists.select("item_id", F.posexplode(shown).alias("_p", "_s")).select(
        "item_id", (F.col("_p") + 1).alias("position"), *[f"_s.e.{n}" for n in ("tag", "category", "tier", "prob")]
    )


def important_tag_probs(vec: Column, picked: list[tuple[str, int]]) -> Column:
    """Map of the picked tags to their element of the vector; `picked` is (name, index)."""
    names = F.array(*[F.lit(n) for n, _ in picked])
    return F.map_from_arrays(names, take_indices(vec, [i for _, i in picked]))


def axis_indices(vocabulary: DataFrame, categories: DataFrame) -> dict[str, list[int]]:
    """Sorted vector positions of each axis; characters by name go to the character axis.

    The vocabulary is as long as a vector, which is why it fits on the driver.
    """
    joined = vocabulary.join(categories, "tag", "left")
    axis = F.when(F.col("kind") == "character", V.AXES[0]).otherwise(F.col("category"))
    rows = joined.select("idx", axis.alias("axis")).where(F.col("axis").isin(V.AXES))
    found = rows.groupBy("axis").agg(F.array_sort(F.collect_list("idx")).alias("idx")).collect()
    return {**{a: [] for a in V.AXES}, **{r["axis"]: r["idx"] for r in found}}


def axis_vectors(df: DataFrame, indices: dict[str, list[int]], vec: str = "vec") -> DataFrame:
    """Adds one shorter vector per axis."""
    return df.withColumns({axis: take_indices(F.col(vec), idx) for axis, idx in indices.items()})


def group_tags_by_type(df: DataFrame, column: str = "tags") -> DataFrame:
    """Split an array of {type, name} into one array per type code."""
    has = lambda code: lambda tag: tag["type"] == code
    return df.withColumns({n: F.filter(column, has(code)) for n, code in V.TAG_TYPE_CODES.items()})


def active_flags(struct: str, flags: list[str], ordinal: str | None = None, names: tuple[str, str] | None = None) -> Column:
    """Names of the set flags in the given order, after the name an ordinal stands for (1, or 2 and more)."""
    field = lambda n: F.col(f"{struct}.{n}")
    first = []
    if ordinal:
        first = [F.when(field(ordinal) == 1, names[0]).when(field(ordinal) >= 2, names[1])]
    return F.array_compact(F.array(*first, *[F.when(field(n), F.lit(n)) for n in flags]))


def select_variant(df: DataFrame, column: str, provider: str) -> DataFrame:
    """Adds the provider's member of a JSON union column as text, null on other providers' rows."""
    return df.withColumn(provider, F.get_json_object(column, f"$.{provider}"))
