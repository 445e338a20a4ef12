"""Pages, ranks and top lists. The item id is always the last sort key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.functions.keys import resolve_path
from vitrine.operators.filters import filter_items
from vitrine.operators.scale import number_rows, top_per_group, top_rows


def explode_fields(items: DataFrame, keep=("item_id", "date"), column: str = "inferences") -> DataFrame:
    """One row per stored number: `keep`, model, field, value."""
    models = items.select(*keep, F.explode(column).alias("model", "_fields"))
    return models.select(*keep, "model", F.explode("_fields").alias("field", "value")).where("value IS NOT NULL")


def score_ranks(items: DataFrame) -> DataFrame:
    """Position of every inferred item among its date, for every score it has.

    A day may hold most of the catalogue, so ranks come from range partitions.
    """
    rows = explode_fields(filter_items(items).where("date IS NOT NULL"))
    return number_rows(rows, ["date", "model", "field"], [F.desc("value"), F.asc("item_id")], "rank", "total")


def item_ranks(items: DataFrame, item_id) -> DataFrame:
    """All fields of one item with rank and total among its date; an item that is not ranked gets a null rank.

    Nothing is sorted: the item's few scores are broadcast to the scan of its date, and the rows
    before each are counted. A date held as a partition is pruned by the item's.
    """
    mine = items.where(F.col("item_id") == item_id)
    one = explode_fields(mine, keep=["item_id", "date"])
    ranked = filter_items(items).where(F.col("date") == mine.agg(F.max("date")).scalar())
    asked = F.broadcast(one.select("model", "field", F.col("value").alias("_v")).distinct())
    before = (F.col("value") > F.col("_v")) | ((F.col("value") == F.col("_v")) & (F.col("item_id") < item_id))
    counts = explode_fields(ranked, keep=["item_id"]).join(asked, ["model", "field"]).groupBy("model", "field").agg(
        F.count_if(before).alias("_before"), F.count("*").alias("total"), F.max(F.col("item_id") == item_id).alias("_in")
    )
    return (
        one.join(F.broadcast(counts), ["model", "field"], "left")
        .withColumn("rank", F.when(F.col("_in"), F.col("_before") + 1))
        .drop("_before", "_in")
    )


def top_items(items: DataFrame, date: str, path: str, cursor: float | None = None, k: int = V.TOP_ITEMS) -> DataFrame:
    """Best items of a date strictly below a cursor; 0 or none starts at the top."""
    value = resolve_path(items, path, checked=False)
    rows = items.where((F.col("date") == date) & value.isNotNull()).withColumn("value", value)
    if cursor:
        rows = rows.where(F.col("value") < cursor)
    return top_rows(rows, [F.desc("value"), F.asc("item_id")], k)


def page_items(
    items: DataFrame, path: str, direction: str = "desc", page: int = 0, limit: int = V.PAGE_SIZE, **filters
) -> tuple[DataFrame, DataFrame]:
    """(rows of a page, one row with the total) of the filtered items having the sort field."""
    if not 1 <= limit <= V.PAGE_SIZE_MAX or page < 0:
        raise ValueError(f"limit must be 1 to {V.PAGE_SIZE_MAX} and page 0 or more")
    value = resolve_path(items, path)
    rows = filter_items(items, **filters).where(value.isNotNull()).withColumn("value", value)
    order = F.asc("value") if direction == "asc" else F.desc("value")
    return top_rows(rows, [order, F.asc("item_id")], limit, page * limit, narrow=["item_id", "value"]), rows.agg(F.count("*").alias("total"))


def keyset_page(
    df: DataFrame, value: str, after=None, size: int = V.PAGE_SIZE, descending: bool = True
) -> DataFrame:
    """The rows after `(value, item_id)` of the previous page's last row."""
    if after is not None:
        v, i = F.col(value), F.col("item_id")
        beyond = v < after[0] if descending else v > after[0]
        df = df.where(beyond | ((v == after[0]) & (i > after[1])))
    return top_rows(df, [F.desc(value) if descending else F.asc(value), F.asc("item_id")], size)


def top_bottom(df: DataFrame, score: str, k: int, k2: int | None = None, by=()) -> DataFrame:
    """The k highest and k2 lowest rows per group with ranks from 1 in `side`; rows without a score are left out."""
    df = df.where(F.col(score).isNotNull())
    high = top_per_group(df, list(by), [F.desc(score), F.asc("item_id")], k)
    low = top_per_group(df, list(by), [F.asc(score), F.asc("item_id")], k2 or k)
    return high.withColumn("side", F.lit("top")).unionByName(low.withColumn("side", F.lit("bottom")))


def confusion_extremes(scored: DataFrame, n: int, by=("model", "y")) -> DataFrame:
    """Highest and lowest scores among positives and among negatives."""
    return top_bottom(scored, "score", n, by=by)


def rank_of_fields(ranks: DataFrame) -> DataFrame:
    """Fields of an item, best rank first, unranked last."""
    return ranks.orderBy(F.asc_nulls_last("rank"), "model", "field")


def top_tags(df: DataFrame, column: str = "probs") -> DataFrame:
    """item_id, tag, prob, position of every stored tag probability, most likely first."""
    entries = F.transform(
        F.map_entries(column), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("tag"))
    )
    return df.select("item_id", F.posexplode(F.array_sort(entries)).alias("pos", "e")).select(
        "item_id", F.col("e.tag").alias("tag"), (-F.col("e.neg")).alias("prob"), (F.col("pos") + 1).alias("position")
    )


def latest_available_date(items: DataFrame, today: Column) -> DataFrame:
    """Newest date with an inferred item in this month or the three before, else today."""
    day = F.date_format(today, "yyyy-MM-dd")
    first = F.date_format(F.trunc(F.add_months(today, -3), "month"), "yyyy-MM-dd")
    last = F.date_format(F.last_day(today), "yyyy-MM-dd")
    shown = items.where((F.col("status") == V.INFERRED) & F.col("date").between(first, last))
    return shown.agg(F.coalesce(F.max("date"), day).alias("date"))


def newest_item(items: DataFrame, column: str) -> DataFrame:
    """`column` of the newest-dated inferred row that has it; one row at most."""
    rows = items.where((F.col("status") == V.INFERRED) & F.col(column).isNotNull())
    return rows.orderBy(F.desc("date"), F.asc("item_id")).limit(1).select(column)


def inference_models(items: DataFrame) -> DataFrame:
    """model, kind and fields as found in the newest inferred row."""
    models = newest_item(items, "inferences").select(F.explode("inferences").alias("model", "_f"))
    pu = F.map_contains_key("_f", "score")
    return models.select(
        "model",
        F.when(pu, "pu").otherwise("legacy_multiclass").alias("kind"),
        F.when(pu, F.array(F.lit("score"))).otherwise(F.map_keys("_f")).alias("fields"),
    ).orderBy("model")


def important_tags(items: DataFrame, column: str = "important_tag_probs", primary: str = "deepdanbooru") -> DataFrame:
    """feature, tag names as found in the newest inferred row with tags of the primary feature."""
    rows = items.where(F.size(F.try_element_at(F.col(column), F.lit(primary))) > 0)
    maps = newest_item(rows, column).select(F.explode(column).alias("feature", "_t"))
    return maps.select("feature", F.explode(F.map_keys("_t")).alias("tag"))


def named_sort(name: str) -> tuple[str, str]:
    """(path, direction) of a preset; an unknown name gives the default."""
    return V.SORT_PRESETS.get(name, V.SORT_PRESETS[V.DEFAULT_SORT])


def sort_by_preset(df: DataFrame, name: str, size: int = V.PAGE_SIZE) -> DataFrame:
    """First page under a preset; rows without the field are left out."""
    path, direction = named_sort(name)
    value = resolve_path(df, path, checked=False)
    return keyset_page(df.where(value.isNotNull()).withColumn("value", value), "value", None, size, direction == "desc")


def latest_children(log: DataFrame, parent=None, n: int = 50, key: str = "parent_id", at: str = "created_at") -> DataFrame:
    """Newest rows of a log, of one parent if given."""
    rows = log if parent is None else log.where(F.col(key) == parent)
    return top_rows(rows, [F.desc(at), F.asc("item_id")], n)


def top_unlabeled(splits: DataFrame, scores: DataFrame, n: int, split: str | None = None) -> DataFrame:
    """Best scored unlabeled rows of each model, of one split or of all."""
    rows = splits.where(F.col("label") == V.UNLABELED)
    if split:
        rows = rows.where(F.col("split") == split)
    joined = rows.select("item_id").join(scores.select("item_id", "model", "score"), "item_id")
    return top_per_group(joined, ["model"], [F.desc("score"), F.asc("item_id")], n)
