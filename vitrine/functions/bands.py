"""Labels, bands and ratios shown next to an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import values as V


def _ladder(bands, holds, value: Column) -> Column:
    column = None
    for bound, name in reversed(bands):
        column = F.lit(name) if bound is None else F.when(holds(value, bound), name).otherwise(column)
    return column


def score_band(score: Column) -> Column:
    return _ladder(V.SCORE_BANDS, lambda v, b: v >= b, score)


def rating_band(rating: Column) -> Column:
    return F.when(rating.isNull(), "Unknown").otherwise(_ladder(V.RATING_BANDS, lambda v, b: v <= b, rating))


def rank_weight(rank: Column, total: Column) -> Column:
    """100 for the first rank, falling with a high power; 0 without rank."""
    shown = F.pow((total - rank + 1) / F.nullif(total, F.lit(0)), V.RANK_POWER) * 100
    return F.coalesce(shown, F.lit(0.0))


def rank_band(rank: Column, total: Column) -> Column:
    share = 1 - F.pow(1 - rank / F.nullif(total, F.lit(0)), V.RANK_POWER)
    return F.when(share.isNull(), V.RANK_BANDS[-1][1]).otherwise(_ladder(V.RANK_BANDS, lambda v, b: v <= b, share))


def count_intensity(days: DataFrame, date: str = "date", count: str = "n") -> DataFrame:
    """Share of the busiest day of the month (at least `BUSY_DAY`); input is one row per day."""
    month = F.substring(date, 1, 7)
    busiest = days.groupBy(month.alias("_month")).agg(F.max(count).alias("_max"))
    joined = days.withColumn("_month", month).join(busiest, "_month")
    share = F.least(F.col(count) / F.greatest("_max", F.lit(V.BUSY_DAY)), F.lit(1.0))
    return joined.withColumn("intensity", share).drop("_month", "_max")


def aspect_ratio(width: Column, height: Column) -> Column:
    """Clamped to [0.5, 2]; null unless both sides are known."""
    return F.when((width > 0) & (height > 0), F.least(F.greatest(width / height, F.lit(0.5)), F.lit(2.0)))


def provider_rating_label(provider: Column, code: Column) -> Column:
    pairs = []
    for name, labels in V.RATING_LABELS.items():
        for c, label in labels.items():
            pairs += [F.lit(f"{name}:{c}"), F.lit(label)]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws(":", provider, code))
