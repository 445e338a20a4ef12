"""Row selection. Every predicate is a plain column comparison, so scans can push it down."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.functions.keys import resolve_path
from vitrine.operators.scale import matching, top_rows


def filter_items(
    df: DataFrame,
    date: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    type: str | None = None,
) -> DataFrame:
    """Inferred items of a date, or of an inclusive range; an exact date wins."""
    for d in (date, date_from, date_to):
        if d is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
            raise ValueError(f"not a YYYY-MM-DD date: {d}")
    out = df.where(F.col("status") == V.INFERRED)
    if date:
        out = out.where(F.col("date") == date)
    else:
        if date_from:
            out = out.where(F.col("date") >= date_from)
        if date_to:
            out = out.where(F.col("date") <= date_to)
    return out.where(F.col("type") == type) if type else out


def field_exists(df: DataFrame, path: str) -> DataFrame:
    return df.where(resolve_path(df, path).isNotNull())


def between(df: DataFrame, value: Column, low=None, high=None) -> DataFrame:
    """Inclusive range, either side optional."""
    if low is not None:
        df = df.where(value >= low)
    if high is not None:
        df = df.where(value <= high)
    return df


def filter_provider_range(df: DataFrame, provider: str, low=None, high=None) -> DataFrame:
    return between(df, resolve_path(df, f"moderations.{provider}.result", checked=False), low, high)


def filter_author(df: DataFrame, author: str) -> DataFrame:
    return df.where(F.col("source.user.id_str") == author)


def filter_tag(df: DataFrame, tags: DataFrame, tag: str, category: str, tier: str) -> DataFrame:
    """Items carrying a tag; `tags` is the long table (item_id, tier, category, tag)."""
    hit = (F.col("tag") == tag) & (F.col("category") == category) & (F.col("tier") == tier)
    return df.join(tags.where(hit).select("item_id").distinct(), "item_id", "left_semi")


def with_captions(page: DataFrame, size: int = V.PAGE_SIZE, column: str = "captions") -> DataFrame:
    """Rows with captions of an already limited page, which may therefore come out short.

    Adds has_next, decided on the page before this filter: a full page may have a successor.
    """
    full = F.count("*").over(Window.partitionBy()) == size
    return page.withColumn("has_next", full).where(F.size(column) > 0)


def pending(items: DataFrame, path: str = "local_path") -> DataFrame:
    """Items still to be scored, or failed before, that have a path."""
    return items.where(F.col("status").isin(V.PENDING, V.ERROR) & F.col(path).isNotNull())


def select_pending(items: DataFrame, files: DataFrame, path: str = "local_path") -> DataFrame:
    """Items still to be scored whose file is there."""
    waiting = pending(items, path)
    there = matching(files.select(F.col("path").alias(path)), waiting, [path])
    return waiting.join(there, path, "left_semi")


def needs_backfill(df: DataFrame, path: str = "local_path", facts=("width", "file_size", "sha256")) -> DataFrame:
    missing = F.lit(False)
    for c in facts:
        missing = missing | F.col(c).isNull()
    return df.where(F.col(path).isNotNull() & missing)


def labeling_pool(
    files: DataFrame, used: DataFrame, cutoff: str, source: str, window: tuple[str, str]
) -> DataFrame:
    """Files older than `cutoff`, or of one source within an inclusive window, not used yet."""
    at = F.col("modified_at")
    extra = (F.col("source") == source) & at.between(F.lit(window[0]).cast("timestamp"), F.lit(window[1]).cast("timestamp"))
    pool = files.where((at < F.lit(cutoff).cast("timestamp")) | extra)
    return pool.join(used.select("path"), "path", "left_anti")


def filter_label_state(files: DataFrame, labels: DataFrame, state: str, label: str | None = None) -> DataFrame:
    """Files by state: all, unlabeled, labeled or skipped; `label` narrows state labeled only."""
    joined = files.join(labels.select("path", "label"), "path", "left")
    known, skipped = F.col("label").isNotNull(), F.col("label") == V.SKIP
    states = {"all": F.lit(True), "unlabeled": ~known, "labeled": known & ~skipped, "skipped": known & skipped}
    out = joined.where(states[state])
    return out.where(F.col("label") == label) if label in V.VALID_LABELS and state == "labeled" else out


def label_page(
    files: DataFrame, labels: DataFrame, state: str = "all", label=None, direction="asc", offset: int = 0, limit: int = V.PAGE_SIZE
) -> tuple[DataFrame, DataFrame]:
    """(rows of a window in path order, one row with the total) of files in a label state."""
    rows = filter_label_state(files, labels, state, label)
    order = F.desc("path") if direction == "desc" else F.asc("path")
    return top_rows(rows, [order], limit, offset), rows.agg(F.count("*").alias("total"))


def validate_favorites(df: DataFrame, flag: str = "isFavorited", categories: str = "categories") -> DataFrame:
    """Adds `valid`: flag and at most 50 categories present, and the flag says whether there are any."""
    size = F.size(categories)
    ok = (
        F.col(flag).isNotNull()
        & F.col(categories).isNotNull()
        & (size <= 50)
        & ((size == 0) | F.get(categories, F.lit(0)).isNotNull())
        & ((size > 0) == F.col(flag))
    )
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def validate_label(df: DataFrame, valid=None, ratable=None) -> DataFrame:
    """Known labels only; a rating is kept on ratable labels, 1 unless it is 1, 2 or 3."""
    rating = F.when(F.col("rating").isin(1, 2, 3), F.col("rating")).otherwise(F.lit(1))
    return df.where(F.col("label").isin([*(valid or V.VALID_LABELS), V.SKIP])).withColumn(
        "rating", F.when(F.col("label").isin(ratable or V.RATABLE_LABELS), rating)
    )


def processed_by_any(df: DataFrame, models: list[str], columns=("captions", "moderations", "tags")) -> DataFrame:
    """Adds `processed`: some listed model left an entry in one of the map columns."""
    wanted = F.array(*[F.lit(m) for m in models])
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.arrays_overlap(F.map_keys(c), wanted), F.lit(False))
    return df.withColumn("processed", found)
