"""Upserts, appends, replacements and deletes over tables; writers for partitioned parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.scale import broadcast_if_small, is_small, last_per_key, matching, null_safe_join, stored


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Set the supplied fields, insert unknown keys; `order` picks the last write within a batch.

    A null in `updates` means the field was not supplied. A small batch is broadcast, so the
    target is scanned but not shuffled; a large one meets it in a full outer join.
    """
    if order:
        updates = last_per_key(updates, keys, order)
    fields = [c for c in updates.columns if c not in keys]
    fresh = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in fields])
    if is_small(fresh):
        fresh = F.broadcast(fresh)
        unknown = fresh.join(matching(target.select(*keys), fresh, keys), keys, "left_anti")
        merged = target.join(fresh, keys, "left").unionByName(unknown, allowMissingColumns=True)
    else:
        merged = target.join(fresh, keys, "full")
    names = [c for c in target.columns if c not in keys]
    names += [c for c in fields if c not in names]
    value = lambda c: (
        F.coalesce(f"_u_{c}", c) if c in fields and c in target.columns else F.col(f"_u_{c}" if c in fields else c)
    )
    return merged.select(*keys, *[value(c).alias(c) for c in names])


def merge_map(df: DataFrame, column: str, key: Column, value: Column) -> DataFrame:
    """Replace one entry of a map column and keep the others."""
    rest = F.map_filter(column, lambda k, _: k != key)
    merged = F.map_concat(F.coalesce(rest, F.create_map().cast(df.schema[column].dataType)), F.create_map(key, value))
    return df.withColumn(column, merged)


def append_missing(store: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `batch` whose key is not stored yet: what a resumed run still has to append."""
    return batch.join(matching(store.select(*keys), batch, keys), keys, "left_anti")


def append_features(batch: DataFrame, path: str, feature: str) -> None:
    """Append the (item_id, vec) rows of a feature that its store lacks; a rerun adds nothing."""
    rows = batch.select("item_id", F.col("vec").cast("array<float>").alias("vec"))
    kind = dict(rows.dtypes)["item_id"]
    if exists(batch.sparkSession, path):
        store = batch.sparkSession.read.schema(f"item_id {kind}, feature_name string").parquet(path)
        rows = append_missing(store.where(F.col("feature_name") == feature), rows, ["item_id"])
    rows.withColumn("feature_name", F.lit(feature)).write.partitionBy("feature_name").mode("append").parquet(path)


def vector_points(df: DataFrame, axes: dict[str, str]) -> DataFrame:
    """One point per item and axis: id, unit norm and payload. `axes` maps axis to vector column."""
    from vitrine.functions.keys import uuid5
    from vitrine.functions.vectors import norm

    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("vec")) for a, c in axes.items()]))
    points = df.select("item_id", "date", "type", "status", pairs.alias("p")).where("p.vec IS NOT NULL")
    return points.select(
        uuid5(F.col("item_id").cast("string")).alias("uuid"),
        "item_id",
        F.col("p.axis").alias("axis"),
        F.col("p.vec").alias("vec"),
        norm(F.col("p.vec")).alias("norm"),
        "date",
        "type",
        "status",
    )


def upsert_vectors(df: DataFrame, axes: dict[str, str], path: str) -> None:
    """Insert or replace points in a table partitioned by axis and date; a point may change its date."""
    upsert_partitions(vector_points(df, axes), path, ["item_id", "axis"], ["axis", "date"])


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Drop the old rows of every key in `new`, then append `new`."""
    kept = existing.join(broadcast_if_small(new.select(*keys).distinct()), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_metrics(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows although columns differ."""
    return existing.unionByName(new, allowMissingColumns=True)


def _anchor_time(df: DataFrame, anchor: str, key: str, created: str) -> Column:
    return df.where(F.col(key) == anchor).agg(F.min(created)).scalar()


def _has_file(key: str) -> Column:
    return F.coalesce(F.element_at(F.split(key, "/"), -1), F.lit("")) != ""


def delete_from_anchor(df: DataFrame, anchor: str, key: str = "key", created: str = "created_at") -> DataFrame:
    """The rows a cleanup removes: made at or after the anchor row, with time and file name.

    Order them by `created` to list the oldest first; `keep_before_anchor` is the complement.
    """
    return df.where((F.col(created) >= _anchor_time(df, anchor, key, created)) & _has_file(key))


def keep_before_anchor(df: DataFrame, anchor: str, key: str = "key", created: str = "created_at") -> DataFrame:
    gone = (F.col(created) >= _anchor_time(df, anchor, key, created)) & _has_file(key)
    return df.where(~F.coalesce(gone, F.lit(False)))


def array_union_ref(df: DataFrame, column: str, ref: Column) -> DataFrame:
    """Append a reference to an array set unless it is there."""
    return df.withColumn(column, F.array_union(F.coalesce(column, F.array().cast(df.schema[column].dataType)), F.array(ref)))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored under `path`; errors of access are raised."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of a table; false if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def upsert_partitions(
    updates: DataFrame, path: str, keys: list[str], by: list[str], order: list[Column] | None = None
) -> None:
    """Replace the stored rows with equal `keys`, in whichever partition they lie, and add the others.

    Of several updates with one key the last in `order` counts (without it, the one with the
    largest values). Null keys and null partitions are values like any other. Only partitions
    that gain or lose a row are rewritten; their merged rows are stored aside first, as a table
    cannot be read and overwritten at once. Partitions left without rows are deleted last.
    """
    others = [c for c in updates.columns if c not in keys]
    # maps have no order
    ranked = [F.col(c) for c in others if "map<" not in updates.schema[c].dataType.simpleString()]
    updates = stored(last_per_key(updates, keys, order or ranked or [F.lit(0)]))
    spark = updates.sparkSession
    if not exists(spark, path):
        return write_partitions(updates, path, by)
    existing = spark.read.schema(updates.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"))
    changed = broadcast_if_small(updates.select(*keys))
    touched = updates.select(*by).union(null_safe_join(existing, changed, keys, "left_semi").select(*by)).distinct()
    inside = stored(null_safe_join(existing, broadcast_if_small(stored(touched)), by, "left_semi"))
    kept = null_safe_join(inside, changed, keys, "left_anti").select(*updates.columns)
    merged = stored(kept.unionByName(updates))
    # one name per file of a partition that loses its last row
    gone = null_safe_join(inside, merged.select(*by).distinct(), by, "left_anti").select("_file").distinct().collect()
    write_partitions(merged, path, by)
    for row in gone:
        drop_folder(spark, row["_file"])


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in `df`."""
    df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
