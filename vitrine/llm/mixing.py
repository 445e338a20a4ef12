"""Mixing item types to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.scale import is_small, skew_join, stored

# A mean above this is drawn as a sum of several independent draws, so exp(-mean) stays exact.
CHUNK = 8.0
# Counts a draw of mean CHUNK can take; beyond, the probability is below 1e-30.
TERMS = 64
OWN = ("copy", "shuffle_key", "_key", "_rate", "_cdf", "_draws", "_copies", "_who")


def _who(caption: str | None) -> Column:
    text = F.md5(F.coalesce(F.col(caption), F.lit(""))) if caption else F.lit("")
    return F.coalesce(F.col("item_id").cast("string"), F.concat(F.lit("#"), text))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the joined parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def repetition_rates(items: DataFrame, targets: DataFrame, total: float | None = None, size: str | None = None) -> DataFrame:
    """type, rate: mean copies of each item so that types reach `targets` (type, weight).

    A type's share of the weights is its share of the output: rate = share * total / what the
    type holds, counted in rows or in the sum of `size`; `total` is what the input holds by
    default. Types of the input without a positive weight get rate 0.
    """
    amount = F.sum(F.coalesce(F.col(size).cast("double"), F.lit(0.0))) if size else F.count("*").cast("double")
    held = items.groupBy("type").agg(amount.alias("_held")).withColumn("_key", _key(F.col("type")))
    wanted = targets.groupBy(_key(F.col("type")).alias("_key")).agg(F.greatest(F.sum("weight"), F.lit(0)).cast("double").alias("_w"))
    # weights of types that the input lacks cannot be met, so they are left out of the sum
    both = held.join(wanted, "_key", "left").fillna(0.0, ["_w"])
    both = stored(both)
    sums = both.where("_held > 0").agg(F.sum("_w").alias("w"), F.sum("_held").alias("held")).first()
    weights, whole = sums["w"] or 0.0, float(total) if total is not None else sums["held"] or 0.0
    if not weights:
        return both.select("type", F.lit(0.0).alias("rate"))
    share = F.col("_w") / F.lit(weights) * F.lit(whole) / F.col("_held")
    return both.select("type", F.when(F.col("_held") > 0, share).otherwise(0.0).alias("rate"))


def _cumulative(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution."""
    start = F.struct(F.array(F.exp(-mean)).alias("c"), F.exp(-mean).alias("p"), F.exp(-mean).alias("s"))
    step = lambda a, k: F.struct(
        F.concat(a["c"], F.array(a["s"] + a["p"] * mean / k)).alias("c"),
        (a["p"] * mean / k).alias("p"),
        (a["s"] + a["p"] * mean / k).alias("s"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["c"])


def mix_types(
    items: DataFrame, targets: DataFrame, seed: int = 0, total: float | None = None, size: str | None = None, caption: str | None = None
) -> DataFrame:
    """Items repeated so that types meet `targets` (type, weight), in one global random order.

    Every item draws its number of copies from a Poisson distribution with its type's mean
    repetition rate (`repetition_rates`), by inverting it at a hash of (seed, item_id): the draw
    depends on nothing else, so any partitioning, retry or engine repeats it. Returns the input's
    columns plus copy (int, from 0) and shuffle_key (double); rows are spread over partitions by
    a hash of the key and sorted by it within each.

    Only the table of rates (one row per type) is joined: broadcast when measured small, salted
    for hot types otherwise. Copies are made before the only shuffle of the rows.

    A null type is a type of its own. A null item_id draws by the MD5 of its `caption` column, if
    named. Repeated rows draw the same number. A type without a weight, or of weight zero or
    less, gets no copies; an empty table stays empty. Input columns named copy or shuffle_key
    are replaced.
    """
    kept = items.drop(*OWN)
    means = repetition_rates(kept, targets, total, size).where("rate > 0")
    draws = F.greatest(F.ceil(F.col("rate") / CHUNK).cast("int"), F.lit(1))
    table = means.select(
        _key(F.col("type")).alias("_key"), draws.alias("_draws"), _cumulative(F.col("rate") / draws).alias("_cdf")
    )
    keyed = kept.withColumns({"_key": _key(F.col("type")), "_who": _who(caption)})
    if is_small(table):
        joined = keyed.join(F.broadcast(table), "_key")
    else:
        joined = skew_join(keyed, table, ["_key"], "inner", ["_who"])
    numbers = F.transform(F.sequence(F.lit(0), F.col("_draws") - 1), lambda j: uniform(F.lit(str(seed)), F.col("_who"), j.cast("string")))
    below = lambda u: F.size(F.filter("_cdf", lambda c: c < u))
    copies = F.aggregate(numbers, F.lit(0), lambda n, u: n + below(u))
    # sequence(1, 0) would count down, hence the slice
    places = F.slice(F.sequence(F.lit(0), copies), F.lit(1), copies)
    rows = joined.select(*kept.columns, "_who", F.explode(places).alias("copy"))
    key = uniform(F.lit(f"{seed}s"), F.col("_who"), F.col("copy").cast("string"))
    return rows.withColumn("shuffle_key", key).drop("_who").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
