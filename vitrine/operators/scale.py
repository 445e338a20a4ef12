"""Building blocks that keep every other operator safe when one key holds most of the rows.

Nothing here puts a whole group into one task: ranks and running sums work on range
partitions, joins salt the keys a sample finds hot, top-k lists are cut before the shuffle.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast side is never larger than this, by the sum of its rows' widths.
BROADCAST_BYTES = 64 << 20
# Above this many times the limit, the planner's own estimate is enough to say no; from UNKNOWN
# on it is the planner's word for rows it knows nothing about.
SURELY_LARGE, UNKNOWN = 256, 1 << 60
# Spark cuts `row_number() <= k` before the shuffle only below this k.
GROUP_LIMIT = 1000
# A page ending beyond this row is found by rank: every task would send that many rows to one.
SHALLOW = 2000

_stored: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or a local one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="vitrine-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, lost executors do no harm."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    _stored.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables `stored` wrote in this process; call it when their results are used up."""
    jvm, gone = spark.sparkContext._jvm, 0
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only after measuring; otherwise leave the join to Spark."""
    return F.broadcast(df) if is_small(df) else df


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes one value takes, about; nested values by their JSON text."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.greatest(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
    return F.lit(16)


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether all rows together take at most `limit` bytes: one sum, combined before the shuffle."""
    limit = BROADCAST_BYTES if limit is None else limit
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if SURELY_LARGE * limit < int(str(estimate)) < UNKNOWN:
        return False
    widths = [_width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields]
    total = df.select(sum(widths, F.lit(0)).alias("_b")).agg(F.sum("_b")).first()[0]
    return (total or 0) <= limit


def matching(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `big` whose key is in `small`.

    Small key lists are broadcast, so a stored catalogue is scanned but never shuffled for a
    batch of new rows.
    """
    return big.join(broadcast_if_small(small.select(*keys).distinct()), keys, "left_semi")


def matching_if_small(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """`matching`, or all of `big` if the key list is not small: for joins on `keys` that drop the other rows anyway.

    A list too large to broadcast would shuffle `big` once more than the join that follows.
    """
    wanted = small.select(*keys).distinct()
    return big.join(F.broadcast(wanted), keys, "left_semi") if is_small(wanted) else big


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe equi join on `keys`, keeping the left copy of them."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def number_rows(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    rank: str = "rank",
    total: str | None = None,
    sums: list[str] | None = None,
    totals: list[str] | None = None,
) -> DataFrame:
    """`row_number` per group without ever holding a group in one task.

    Rows are range partitioned by (group, order), as many parts as `spark.sql.shuffle.partitions`
    (fewer for little data, adaptive execution joins neighbours), and stored once. Each then only
    needs to know how many rows of its groups lie in earlier partitions, a table of at most
    one row per group and partition. `total` names a column for the group size; every column
    in `sums` also gets `<name>_upto` (running sum, this row included) and `<name>_total`,
    every column in `totals` only the latter.
    """
    sums = sums or []
    summed = sums + [c for c in totals or [] if c not in sums]
    keys = [F.col(g).asc() for g in group] + list(order)
    ordered = stored(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_seq", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_seq", 33))

    chunks = ordered.groupBy(*group, "_part").agg(
        F.count("*").alias("_n"),
        F.min("_seq").alias("_first"),
        *[F.sum(c).alias(f"_s_{c}") for c in summed],
    )
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = broadcast_if_small(
        stored(
            chunks.select(
                *group,
                "_part",
                "_first",
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                F.sum("_n").over(whole).alias("_total"),
                *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums],
                *[F.sum(f"_s_{c}").over(whole).alias(f"{c}_total") for c in summed],
            )
        )
    )
    if sums:
        running = (
            Window.partitionBy(*group, "_part")
            .orderBy("_seq")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        ordered = ordered.withColumns({f"_u_{c}": F.sum(c).over(running) for c in sums})
    placed = null_safe_join(ordered, offsets, [*group, "_part"], "inner")
    placed = placed.withColumn(rank, F.col("_before") + F.col("_seq") - F.col("_first") + 1)
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    for c in sums:
        placed = placed.withColumn(f"{c}_upto", F.col(f"_b_{c}") + F.coalesce(F.col(f"_u_{c}"), F.lit(0)))
    helpers = ["_seq", "_part", "_first", "_before", "_total"]
    return placed.drop(*helpers, *[f"_b_{c}" for c in sums], *[f"_u_{c}" for c in sums])


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank", lanes: int = 64
) -> DataFrame:
    """The first k rows of every group, ranked from 1.

    Every task hands on at most k rows per group, but a cluster has many tasks: they are merged
    in `lanes` first, so that the last step sees at most `lanes` * k rows of a group. Lists of
    the best are the same whichever lane a row takes. 0 lanes skips this, for groups that are
    small already.
    """
    if k >= GROUP_LIMIT:
        return number_rows(df, group, order, rank).where(F.col(rank) <= k)

    def first(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)

    if lanes:
        laned = df.withColumn("_lane", F.spark_partition_id() % lanes)
        df = first(laned, [*group, "_lane"]).drop("_lane", rank)
    return first(df, group)


def top_rows(df: DataFrame, order: list[Column], k: int, skip: int = 0, narrow: list[str] | None = None) -> DataFrame:
    """`k` rows after the first `skip`; a deep page is found by rank, not by sorting on the driver.

    `narrow` names the columns that `order` reads, a unique key first. Then only these are ranked
    and stored, and the k keys of the page pick its rows.
    """
    if skip + k <= SHALLOW:
        return df.orderBy(*order).offset(skip).limit(k)
    ranked = number_rows(df.select(*narrow) if narrow else df, [], order, "_rank").where(F.col("_rank").between(skip + 1, skip + k))
    if narrow:
        ranked = df.join(F.broadcast(ranked.select(narrow[0], "_rank")) if k <= SHALLOW else ranked.select(narrow[0], "_rank"), narrow[0])
    return ranked.orderBy("_rank").select(*df.columns)


def seeded_order(seed: int, key: str = "item_id") -> Column:
    """A shuffled order that any engine with SHA-256 can repeat."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest `order` per key; combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the largest `order` per key; combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def _sampled_counts(df: DataFrame, on: list[str], spread: list[str], min_hot: int, sample: int) -> tuple[DataFrame, int, bool]:
    """Rows per key in a hash sample of `df`, the count from which a key is hot, and whether any key is."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = [F.col(k).isNotNull() for k in on]
    picked = F.pmod(F.xxhash64(*spread), F.lit(sample)) == 0 if sample > 1 else F.lit(True)
    counts = df.where(picked).where(reduce(and_, known)).groupBy(*on).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    least = max(1, min_hot // sample, -(-(total or 0) // (2 * parts)))
    return counts, least, (most or 0) >= least


def hot_keys(df: DataFrame, on: list[str], spread: list[str], min_hot: int, sample: int) -> DataFrame:
    """Keys that alone fill half of a task's fair share of `df`, and have at least `min_hot` rows.

    Counted on a hash sample of the rows. A key needs 1 / 2p of the sampled rows for p shuffle
    partitions, so there are never more than 2p such keys, whatever the data holds.
    """
    counts, least, _ = _sampled_counts(df, on, spread, min_hot, sample)
    return counts.where(F.col("_n") >= least).select(*on)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    salts: int = 64,
    min_hot: int = 2_000,
    sample: int = 16,
) -> DataFrame:
    """Equi join whose hot and null left keys are spread over many tasks.

    `hot_keys` bounds the list of hot keys by arithmetic, so it is safe to broadcast; a key the
    sample misses is only slower. Right rows of a hot key are repeated once per salt. A null key
    matches nothing, so its left rows move by a hash of `spread` alone. `spread` names left
    columns that differ between rows of one key. Without a hot key nothing is salted: the keys are
    not counted again, and an inner join is planned as Spark plans it.
    """
    counts, least, found = _sampled_counts(left, on, spread, min_hot, sample)
    unmatched = reduce(or_, [F.col(k).isNull() for k in on])
    mixed = F.xxhash64(*spread)
    if not found:
        if how == "inner":
            return left.join(right, on, how)
        spared = left.withColumn("_salt", F.when(unmatched, mixed).otherwise(F.lit(0)).cast("long"))
        # exploded, since a plain zero is folded out of the join and null keys would meet again
        zero = F.explode(F.array(F.lit(0).cast("long")))
        return spared.join(right.withColumn("_salt", zero), [*on, "_salt"], how).drop("_salt")
    hot = F.broadcast(counts.where(F.col("_n") >= least).select(*on, F.lit(True).alias("_hot")))
    salted = (
        left.join(hot, on, "left")
        .withColumn(
            "_salt",
            F.when(unmatched, mixed)
            .when(F.col("_hot"), F.pmod(mixed, F.lit(salts)))
            .otherwise(F.lit(0))
            .cast("long"),
        )
        .drop("_hot")
    )
    last = F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0)).cast("long")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), last))
    repeated = right.join(hot, on, "left").withColumn("_salt", copies).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
