"""The catalogue's tables, derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, folder: str) -> DataFrame:
    d, e = table(spark, folder, "documents"), table(spark, folder, "embeddings")
    number = lambda i: F.col("embedding")[i].cast("double")
    scores = F.create_map(F.lit("score"), number(0)), F.create_map(F.lit("score"), number(1))
    multi = F.create_map(*[x for i, c in enumerate(("c0", "c1", "c2")) for x in (F.lit(c), number(i + 2))])
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("type"),
        "lang",
        F.col("n_chars").alias("file_size"),
        F.expr("CASE doc_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' ELSE 'inferred' END").alias("status"),
        F.expr("date_format(date_add(DATE'2024-01-01', CAST(doc_id % 60 AS INT)), 'yyyy-MM-dd')").alias("date"),
        F.sha2("text", 256).alias("sha256"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".jpg")).alias("key"),
        F.expr(f"CASE WHEN doc_id % 11 <> 0 THEN CAST({EPOCH} AS TIMESTAMP) + make_dt_interval(0, 0, 0, (doc_id * 7919) % 100000) END").alias("downloaded_at"),
        number(0).alias("m1_score"),
        F.when(F.col("doc_id") % 7 != 0, number(1)).alias("m2_score"),
        F.map_filter(
            F.create_map(F.lit("m1"), scores[0], F.lit("m2"), scores[1], F.lit("multi"), multi),
            lambda k, _: F.col("embedding").isNotNull() & ((k != "m2") | (F.col("doc_id") % 7 != 0)),
        ).alias("inferences"),
        F.col("embedding").alias("vec"),
        F.col("label").alias("cluster"),
    )


ITEMS = """
items AS (
  SELECT d.doc_id AS item_id, d.source AS type, d.lang, d.n_chars AS file_size,
         CASE d.doc_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' ELSE 'inferred' END AS status,
         strftime(DATE '2024-01-01' + CAST(d.doc_id % 60 AS INT), '%Y-%m-%d') AS date,
         sha256(d.text) AS sha256, d.source || '/' || d.doc_id || '.jpg' AS key,
         CASE WHEN d.doc_id % 11 <> 0 THEN (d.doc_id * 7919) % 100000 END AS second,
         CAST(e.embedding[1] AS DOUBLE) AS m1_score,
         CASE WHEN d.doc_id % 7 <> 0 THEN CAST(e.embedding[2] AS DOUBLE) END AS m2_score,
         e.embedding AS vec, e.label AS cluster
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
fields AS (
  SELECT item_id, status, date, 'm1' AS model, 'score' AS field, m1_score AS value FROM items WHERE vec IS NOT NULL
  UNION ALL SELECT item_id, status, date, 'm2', 'score', m2_score FROM items WHERE m2_score IS NOT NULL
  UNION ALL SELECT item_id, status, date, 'multi', 'c0', CAST(vec[3] AS DOUBLE) FROM items WHERE vec IS NOT NULL
  UNION ALL SELECT item_id, status, date, 'multi', 'c1', CAST(vec[4] AS DOUBLE) FROM items WHERE vec IS NOT NULL
  UNION ALL SELECT item_id, status, date, 'multi', 'c2', CAST(vec[5] AS DOUBLE) FROM items WHERE vec IS NOT NULL)"""


def pu_labels(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, label: pos_a, pos_b, not_bookmarked, or unlabeled where no label row exists."""
    d, l = table(spark, folder, "documents"), table(spark, folder, "labels")
    label = F.expr(
        "CASE WHEN toxic = 1 THEN 'pos_b' WHEN quality = 1 THEN 'pos_a'"
        " WHEN quality = 0 THEN 'not_bookmarked' ELSE 'unlabeled' END"
    )
    return d.select("doc_id", "lang", "source").join(l, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"),
        label.alias("label"),
        F.when((F.col("doc_id") % 4 != 0) & (F.col("toxic") + F.col("quality") >= 1), (F.col("doc_id") % 4).cast("int")).alias("rating"),
        F.when(F.col("lang") == "en", F.col("source")).alias("artwork_id"),
        F.concat(F.lit("/media/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".jpg")).alias("file_path"),
    )


PU_LABELS = """
pu AS (
  SELECT d.doc_id AS item_id,
         CASE WHEN l.toxic = 1 THEN 'pos_b' WHEN l.quality = 1 THEN 'pos_a'
              WHEN l.quality = 0 THEN 'not_bookmarked' ELSE 'unlabeled' END AS label,
         CASE WHEN d.doc_id % 4 <> 0 AND l.toxic + l.quality >= 1 THEN d.doc_id % 4 END AS rating,
         CASE WHEN d.lang = 'en' THEN d.source END AS artwork_id,
         '/media/' || d.source || '/' || d.doc_id || '.jpg' AS file_path
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def scored(spark: SparkSession, folder: str, step: int | None = None) -> DataFrame:
    """model, item_id, label, rating, score of every labelled item under two models."""
    i, l = items(spark, folder), pu_labels(spark, folder)
    shown = (lambda c: F.round(c, step)) if step is not None else (lambda c: c)
    models = F.explode(
        F.create_map(F.lit("m1"), F.col("m1_score"), F.lit("m2"), F.col("m2_score"))
    ).alias("model", "score")
    return (
        i.select("item_id", models)
        .where("score IS NOT NULL")
        .join(l, "item_id")
        .select("model", "item_id", "label", "rating", "artwork_id", shown(F.col("score")).alias("score"))
    )


def scored_sql(step: int | None = None) -> str:
    shown = f"round(score, {step})" if step is not None else "score"
    return f"""
scored AS (
  SELECT model, item_id, label, rating, artwork_id, {shown} AS score FROM (
    SELECT 'm1' AS model, item_id, m1_score AS score FROM items WHERE m1_score IS NOT NULL
    UNION ALL SELECT 'm2', item_id, m2_score FROM items WHERE m2_score IS NOT NULL) JOIN pu USING (item_id))"""


class Registry:
    """Collects the queries of one module with the SQL that must give the same rows."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return keep
