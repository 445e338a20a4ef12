"""Queries for ranking and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import dedup as H
from vitrine.operators import ranking as G
from vitrine.operators.scale import top_rows
from vitrine.plans.fixtures import ITEMS, PU_LABELS, Registry, items, pu_labels, scored, scored_sql, table
from vitrine.plans.q_rows import MODERATED, moderated
from vitrine.plans.q_sources import FAVORITES, favorites

R = Registry()

RANKED = """ranked AS (SELECT item_id, date, model, field, value,
    row_number() OVER (PARTITION BY date, model, field ORDER BY value DESC, item_id) AS rank,
    count(*) OVER (PARTITION BY date, model, field) AS total FROM fields WHERE status = 'inferred')"""


@R.add("g1_score_ranks", f"""
WITH {ITEMS}, {RANKED} SELECT item_id, date, model, field, round(value, 6) AS value, rank, total FROM ranked""")
def _(spark, d):
    return G.score_ranks(items(spark, d)).withColumn("value", F.round("value", 6))


@R.add("g1_item_ranks", f"""
WITH {ITEMS}, {RANKED}, t AS (SELECT date, model, field, count(*) AS total FROM fields WHERE status = 'inferred' GROUP BY ALL)
SELECT f.item_id, f.model, f.field, r.rank, t.total FROM fields f LEFT JOIN ranked r USING (item_id, model, field)
LEFT JOIN t ON t.date = f.date AND t.model = f.model AND t.field = f.field WHERE f.item_id = 22""")
def _(spark, d):
    i = items(spark, d)
    return G.rank_of_fields(G.item_ranks(i, 22)).select("item_id", "model", "field", "rank", "total")


@R.add("g2_top_items", f"""
WITH {ITEMS} SELECT item_id, round(m1_score, 1) AS value FROM items WHERE date = '2024-01-15' AND round(m1_score, 1) < 0.2 ORDER BY round(m1_score, 1) DESC, item_id LIMIT 30""")
def _(spark, d):
    i = items(spark, d).withColumn("shown", F.struct(F.round("m1_score", 1).alias("m1")))
    return G.top_items(i, "2024-01-15", "shown.m1", 0.2).select("item_id", "value")


@R.add("g3_page_items", f"""
WITH {ITEMS} SELECT item_id, round(m2_score, 6) AS value FROM items WHERE status = 'inferred' AND m2_score IS NOT NULL ORDER BY m2_score DESC, item_id LIMIT 50 OFFSET 100""")
def _(spark, d):
    page, _ = G.page_items(items(spark, d), "inferences.m2.score", page=2)
    return page.select("item_id", F.round("value", 6).alias("value"))


@R.add("g3_page_total", f"""
WITH {ITEMS} SELECT count(*) AS total FROM items WHERE status = 'inferred' AND m2_score IS NOT NULL""")
def _(spark, d):
    return G.page_items(items(spark, d), "inferences.m2.score")[1]


@R.add("g3_deep_page", """
SELECT event_id AS item_id, value FROM events ORDER BY value DESC, event_id LIMIT 200 OFFSET 9900""")
def _(spark, d):
    # deep enough to be found by rank
    rows = table(spark, d, "events").select(F.col("event_id").alias("item_id"), "value")
    return top_rows(rows, [F.desc("value"), F.asc("item_id")], 200, 9900, narrow=["item_id", "value"])


@R.add("g4_keyset_page", f"""
WITH {ITEMS}, v AS (SELECT item_id, round(m1_score, 1) AS value FROM items)
SELECT item_id, value FROM v WHERE value < 0.1 OR (value = 0.1 AND item_id > 100) ORDER BY value DESC, item_id LIMIT 50""")
def _(spark, d):
    v = items(spark, d).select("item_id", F.round("m1_score", 1).alias("value"))
    return G.keyset_page(v, "value", (0.1, 100))


@R.add("g5_top_bottom", f"""
WITH {ITEMS} SELECT * FROM (
  SELECT item_id, round(m1_score, 6) AS score, row_number() OVER (ORDER BY m1_score DESC, item_id) AS rank, 'top' AS side FROM items WHERE m1_score IS NOT NULL
  UNION ALL SELECT item_id, round(m1_score, 6), row_number() OVER (ORDER BY m1_score, item_id), 'bottom' FROM items WHERE m1_score IS NOT NULL)
WHERE rank <= CASE side WHEN 'top' THEN 20 ELSE 10 END""")
def _(spark, d):
    out = G.top_bottom(items(spark, d).select("item_id", F.col("m1_score").alias("score")), "score", 20, 10)
    return out.withColumn("score", F.round("score", 6))


@R.add("g6_confusion_extremes", f"""
WITH {ITEMS}, {PU_LABELS}, {scored_sql()}, y AS (SELECT model, item_id, score, CASE WHEN label LIKE 'pos%' THEN 1 ELSE 0 END AS y FROM scored)
SELECT model, y, item_id, side, rank FROM (
  SELECT *, 'top' AS side, row_number() OVER (PARTITION BY model, y ORDER BY score DESC, item_id) AS rank FROM y
  UNION ALL SELECT *, 'bottom', row_number() OVER (PARTITION BY model, y ORDER BY score, item_id) FROM y) WHERE rank <= 10""")
def _(spark, d):
    rows = scored(spark, d).withColumn("y", F.when(F.col("label").startswith("pos"), 1).otherwise(0))
    return G.confusion_extremes(rows.select("model", "y", "item_id", "score"), 10).drop("score")


@R.add("g7_rank_of_fields", f"""
WITH {ITEMS}, {RANKED} SELECT f.item_id, f.model, f.field, r.rank FROM fields f LEFT JOIN ranked r USING (item_id, model, field)""")
def _(spark, d):
    i = items(spark, d)
    all_fields = G.explode_fields(i).select("item_id", "model", "field")
    ranks = G.score_ranks(i).select("item_id", "model", "field", "rank")
    return G.rank_of_fields(all_fields.join(ranks, ["item_id", "model", "field"], "left"))


@R.add("g8_top_tags", """
WITH t AS (SELECT vec_id AS item_id, 't' || i AS tag, (CAST(embedding[i + 1] AS DOUBLE) + 1) / 2 AS p FROM embeddings, range(64) r(i))
SELECT item_id, tag, round(p, 6) AS prob, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, tag) AS position FROM t""")
def _(spark, d):
    names = F.array(*[F.lit(f"t{i}") for i in range(64)])
    probs = F.map_from_arrays(names, F.transform("embedding", lambda x: (x.cast("double") + 1) / 2))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), probs.alias("probs"))
    return G.top_tags(e).withColumn("prob", F.round("prob", 6))


@R.add("g9_latest_available_date", f"""
WITH {ITEMS} SELECT coalesce(max(date), '2024-02-20') AS date FROM items WHERE status = 'inferred' AND date BETWEEN '2023-11-01' AND '2024-02-29'""")
def _(spark, d):
    return G.latest_available_date(items(spark, d), F.lit("2024-02-20").cast("date"))


@R.add("g10_inference_models", f"""
WITH {ITEMS}, n AS (SELECT item_id FROM items WHERE status = 'inferred' ORDER BY date DESC, item_id LIMIT 1)
SELECT model, CASE WHEN model = 'multi' THEN 'legacy_multiclass' ELSE 'pu' END AS kind, array_to_string(list_sort(list(field)), ',') AS fields
FROM fields JOIN n USING (item_id) GROUP BY ALL""")
def _(spark, d):
    return G.inference_models(items(spark, d)).withColumn("fields", F.array_join(F.array_sort("fields"), ","))


@R.add("g10_important_tags", f"""
WITH {ITEMS}, n AS (SELECT cluster FROM items WHERE status = 'inferred' AND m2_score IS NOT NULL ORDER BY date DESC, item_id LIMIT 1)
SELECT 'deepdanbooru' AS feature, 'tag' || cluster AS tag FROM n UNION ALL SELECT 'pixai', 'other' || cluster FROM n""")
def _(spark, d):
    tag = lambda p: F.when(F.col("cluster").isNotNull(), F.create_map(F.concat(F.lit(p), "cluster"), F.col("m1_score")))
    probs = F.map_filter(F.create_map(F.lit("deepdanbooru"), tag("tag"), F.lit("pixai"), tag("other")), lambda k, _: (k == "pixai") | F.col("m2_score").isNotNull())
    return G.important_tags(items(spark, d).withColumn("important_tag_probs", probs))


@R.add("g11_named_sort", f"""
WITH {MODERATED} SELECT item_id, CAST(joycaption AS DOUBLE) AS value FROM moderated WHERE joycaption IS NOT NULL ORDER BY joycaption, item_id LIMIT 50""")
def _(spark, d):
    return G.sort_by_preset(moderated(spark, d), "joycaption-asc").select("item_id", "value")


@R.add("g12_latest_children", """
SELECT event_id AS item_id, user_id AS parent_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 50""")
def _(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("item_id"), F.col("user_id").alias("parent_id"), F.col("ts").alias("created_at"))
    return G.latest_children(log, 7).drop("created_at")


@R.add("g13_top_unlabeled", f"""
WITH {ITEMS}, {PU_LABELS}, {scored_sql()} SELECT * FROM (
  SELECT item_id, model, round(score, 6) AS score, row_number() OVER (PARTITION BY model ORDER BY score DESC, item_id) AS rank FROM scored WHERE label = 'unlabeled') WHERE rank <= 25""")
def _(spark, d):
    s = scored(spark, d)
    return G.top_unlabeled(pu_labels(spark, d), s, 25).withColumn("score", F.round("score", 6))


# ---- duplicates and sets -----------------------------------------------------------------


def files(spark, d):
    """All documents as files with content hash, age and status."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.lpad("doc_id", 9, "0").alias("key"), F.sha2("text", 256).alias("sha256"),
        F.expr("CASE WHEN doc_id % 11 <> 0 THEN timestamp_seconds((doc_id * 7919) % 100000 + 1) END").alias("downloaded_at"),
        F.when(F.col("lang") == "fr", "deduped").otherwise("inferred").alias("status"),
        F.concat(F.lit("/media/"), "doc_id").alias("local_path"), "lang",
    )


FILES = """files AS (SELECT doc_id AS item_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key, sha256(text) AS sha256, lang,
  CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 7919) % 100000 + 1 END AS sec, CASE WHEN lang = 'fr' THEN 'deduped' ELSE 'inferred' END AS status FROM documents)"""


@R.add("h1_dedupe_by_hash", f"""
WITH {FILES}, r AS (SELECT *, row_number() OVER w AS r, first_value(key) OVER w AS c, count(*) OVER (PARTITION BY sha256) AS n FROM files
    WINDOW w AS (PARTITION BY sha256 ORDER BY coalesce(sec, 0), key))
SELECT key, CASE WHEN n > 1 THEN c END AS canonical_key, CASE WHEN n = 1 THEN 'unique' WHEN r = 1 THEN 'canonical' WHEN status = 'deduped' THEN 'already_deduped' ELSE 'deduped' END AS outcome,
  CASE WHEN n > 1 AND r > 1 THEN 'deduped' ELSE status END AS status, CASE WHEN n = 1 OR r = 1 OR status = 'deduped' THEN '/media/' || item_id END AS local_path FROM r""")
def _(spark, d):
    return H.dedupe_by_hash(files(spark, d)).select("key", "canonical_key", "outcome", "status", "local_path")


@R.add("h2_flag_duplicates", f"""
WITH {FILES}, s AS (SELECT sha256, key FROM files WHERE lang = 'en')
SELECT key, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.sha256 = f.sha256) OR EXISTS (SELECT 1 FROM files g WHERE g.lang <> 'en' AND g.sha256 = f.sha256 AND g.key < f.key)
  THEN 'deduped' ELSE 'pending' END AS status FROM files f WHERE lang <> 'en'""")
def _(spark, d):
    f = files(spark, d)
    return H.flag_duplicates(f.where("lang <> 'en'"), f.where("lang = 'en'")).select("key", "status")


@R.add("h3_dedupe_eval", f"""
WITH {FILES} SELECT sha256, min(key) AS file_path, arg_min(item_id, key) AS item_id FROM files GROUP BY 1""")
def _(spark, d):
    return H.dedupe_eval(files(spark, d).select("sha256", F.col("key").alias("file_path"), "item_id"))


@R.add("h4_union_manifest", """
WITH priv AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS a FROM labels WHERE toxic = 1), pub AS (SELECT CAST(doc_id AS VARCHAR) AS a FROM labels WHERE quality = 1),
rows AS (
  SELECT 'pixiv/' || doc_id AS item_id, CASE WHEN CAST(doc_id AS VARCHAR) IN (SELECT a FROM priv) THEN 'pixiv_private' ELSE 'pixiv_public' END AS label, '/a/' || doc_id AS file_path, 0 AS src
    FROM documents WHERE lang = 'en' AND (CAST(doc_id AS VARCHAR) IN (SELECT a FROM priv) OR CAST(doc_id AS VARCHAR) IN (SELECT a FROM pub))
  UNION ALL SELECT 'twitter/' || (doc_id % 100), 'twitter', '/t/' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), 1 FROM documents WHERE lang = 'fr'
  UNION ALL SELECT 'dmc/' || doc_id, 'unlabeled', '/d/' || doc_id, 2 FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT a FROM priv) AND CAST(doc_id AS VARCHAR) NOT IN (SELECT a FROM pub))
SELECT item_id, arg_min(label, (src, file_path)) AS label, arg_min(file_path, (src, file_path)) AS file_path FROM rows GROUP BY 1""")
def _(spark, d):
    docs, l = table(spark, d, "documents"), table(spark, d, "labels")
    text = lambda c: F.col(c).cast("string").alias("artwork_id")
    name = lambda p, c="doc_id": F.concat(F.lit(p), c)
    row = lambda df, i, p: df.select(i.alias("item_id"), text("doc_id"), p.alias("file_path"))
    return H.union_manifest(
        row(docs.where("lang = 'en'"), name("pixiv/"), name("/a/")),
        l.where("toxic = 1").select(text("doc_id")),
        l.where("quality = 1").select(text("doc_id")),
        row(docs.where("lang = 'fr'"), F.concat(F.lit("twitter/"), F.col("doc_id") % 100), F.concat(F.lit("/t/"), F.lpad("doc_id", 9, "0"))),
        row(docs, name("dmc/"), name("/d/")),
    )


@R.add("h5_id_difference", """
SELECT doc_id AS item_id FROM documents EXCEPT SELECT vec_id FROM embeddings""")
def _(spark, d):
    return H.id_difference(table(spark, d, "documents").withColumnRenamed("doc_id", "item_id"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "item_id"))


@R.add("h5_id_intersection", """
SELECT doc_id AS item_id FROM labels INTERSECT SELECT vec_id FROM embeddings""")
def _(spark, d):
    return H.id_intersection(table(spark, d, "labels").withColumnRenamed("doc_id", "item_id"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "item_id"))


@R.add("h6_toggle_category", f"""
WITH {FAVORITES}, t AS (SELECT item_id, CASE WHEN list_contains(categories, '2-HIGH') THEN list_filter(categories, lambda c: c <> '2-HIGH') ELSE list_append(categories, '2-HIGH') END AS c FROM favs)
SELECT item_id, array_to_string(c, ',') AS categories, len(c) > 0 AS "isFavorited" FROM t""")
def _(spark, d):
    out = H.toggle_category(favorites(spark, d), F.lit("2-HIGH"))
    return out.withColumn("categories", F.array_join("categories", ","))


@R.add("h7_migrate_favorites", f"""
WITH {FAVORITES} SELECT item_id, true AS "isFavorited", CASE WHEN len(categories) < 5 THEN array_to_string(categories, ',') ELSE '' END AS categories FROM favs WHERE list_contains(categories, '1-URGENT')""")
def _(spark, d):
    cats = F.when(F.size("categories") < 5, F.col("categories"))
    i = favorites(spark, d).select("item_id", F.struct(F.array_contains("categories", "1-URGENT").alias("isFavorited"), cats.alias("categories")).alias("favorites"))
    return H.migrate_favorites(i).withColumn("categories", F.array_join("categories", ","))


@R.add("h8_label_upsert", """
WITH c AS (SELECT * FROM (SELECT user_id AS path, CASE WHEN event_type <> 'error' THEN event_type END AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)
SELECT doc_id AS path, 'old' AS label, 1 AS rating FROM documents WHERE doc_id NOT IN (SELECT path FROM c) UNION ALL SELECT path, label, 2 FROM c WHERE label IS NOT NULL""")
def _(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("old").alias("label"), F.lit(1).alias("rating"))
    changes = table(spark, d, "events").select(F.col("user_id").alias("path"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"), F.lit(2).alias("rating"), "event_id")
    return H.label_upsert(old, changes, [F.col("event_id")])


@R.add("h9_migrate_label_format", f"""
WITH {PU_LABELS} SELECT item_id, label, CASE WHEN label IN ('pos_a', 'pos_b') THEN 1 END AS rating FROM pu""")
def _(spark, d):
    out = H.migrate_label_format(pu_labels(spark, d).select("item_id", "label"), ratable=["pos_a", "pos_b"])
    return out.select("item_id", "label.label", "label.rating")
