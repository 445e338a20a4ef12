"""Queries for filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.keys import resolve_path
from vitrine.operators import aggregates as A
from vitrine.operators import filters as D
from vitrine.operators import joins as E
from vitrine.operators.scale import top_rows
from vitrine.plans.fixtures import ITEMS, PU_LABELS, Registry, items, pu_labels, scored, scored_sql, table
from vitrine.plans.q_sources import FAVORITES, favorites

R = Registry()


def moderated(spark, d):
    """One row per event: results of two providers, a caption on some."""
    k = F.expr("CAST(get_json_object(props, '$.k') AS INT)")
    entry = lambda v: F.struct(v.cast("double").alias("result"))
    results = F.map_filter(
        F.create_map(F.lit("minicpm"), entry(F.floor(k / 10)), F.lit("joycaption"), entry(F.floor("value"))),
        lambda name, _: (name == "minicpm") | (F.col("event_type") != "error"),
    )
    caption = F.map_filter(F.create_map(F.lit("minicpm"), F.lit("text")), lambda n, _: F.col("event_type") == "view")
    return table(spark, d, "events").select(
        F.col("event_id").alias("item_id"), "user_id", "event_type", results.alias("moderations"), caption.alias("captions"),
        F.struct(F.struct(F.col("user_id").cast("string").alias("id_str")).alias("user")).alias("source"),
    )


MODERATED = """moderated AS (SELECT event_id AS item_id, user_id, event_type, CAST(json_extract(props, '$.k') AS INT) // 10 AS minicpm,
  CASE WHEN event_type <> 'error' THEN floor(value) END AS joycaption, event_type = 'view' AS captioned FROM events)"""

# ---- filters -----------------------------------------------------------------------------


@R.add("d1_filter_items", f"""
WITH {ITEMS} SELECT item_id, date, type FROM items WHERE status = 'inferred' AND date BETWEEN '2024-01-10' AND '2024-02-10'""")
def _(spark, d):
    return D.filter_items(items(spark, d), date_from="2024-01-10", date_to="2024-02-10").select("item_id", "date", "type")


@R.add("d1_filter_items_exact", f"""
WITH {ITEMS} SELECT item_id FROM items WHERE status = 'inferred' AND date = '2024-01-15'""")
def _(spark, d):
    return D.filter_items(items(spark, d), date="2024-01-15", date_from="2024-02-01").select("item_id")


@R.add("d2_field_exists", f"""
WITH {ITEMS} SELECT item_id FROM items WHERE m2_score IS NOT NULL""")
def _(spark, d):
    return D.field_exists(items(spark, d), "inferences.m2.score").select("item_id")


@R.add("d3_filter_provider_range", f"""
WITH {MODERATED} SELECT item_id, CAST(joycaption AS BIGINT) AS result FROM moderated WHERE joycaption BETWEEN 2 AND 5""")
def _(spark, d):
    m = moderated(spark, d)
    out = D.filter_provider_range(m, "joycaption", 2, 5)
    return out.select("item_id", resolve_path(m, "moderations.joycaption.result", checked=False).cast("long").alias("result"))


@R.add("d4_filter_author", """
SELECT event_id AS item_id FROM events WHERE user_id = 7""")
def _(spark, d):
    return D.filter_author(moderated(spark, d), "7").select("item_id")


@R.add("d5_filter_tag", """
SELECT o_custkey AS item_id FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderpriority = '2-HIGH' AND o_orderstatus = 'F') > 0""")
def _(spark, d):
    o = table(spark, d, "orders")
    tags = o.select(F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("tag"), F.lit("feature").alias("category"), F.col("o_orderstatus").alias("tier"))
    return D.filter_tag(o.select(F.col("o_custkey").alias("item_id")).distinct(), tags, "2-HIGH", "feature", "F")


@R.add("d6_with_captions", f"""
WITH {MODERATED}, page AS (SELECT * FROM moderated ORDER BY minicpm DESC, item_id LIMIT 50)
SELECT item_id, minicpm, true AS has_next FROM page WHERE captioned""")
def _(spark, d):
    m = moderated(spark, d)
    value = resolve_path(m, "moderations.minicpm.result", checked=False).cast("long")
    page = top_rows(m.withColumn("minicpm", value), [F.desc("minicpm"), F.asc("item_id")], 50)
    return D.with_captions(page).select("item_id", "minicpm", "has_next")


def with_paths(spark, d):
    return items(spark, d).withColumn("local_path", F.when(F.col("lang") != "es", F.concat(F.lit("/media/"), "key")))


LOCAL = "CASE WHEN lang <> 'es' THEN '/media/' || key END"


@R.add("d7_select_pending", f"""
WITH {ITEMS} SELECT item_id, status FROM items WHERE status IN ('pending', 'error') AND lang <> 'es'
  AND item_id IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    have = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    files = have.select(F.concat(F.lit("/media/"), "source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("path"))
    return D.select_pending(with_paths(spark, d), files).select("item_id", "status")


@R.add("d8_needs_backfill", f"""
WITH {ITEMS} SELECT item_id FROM items WHERE lang <> 'es' AND m2_score IS NULL""")
def _(spark, d):
    return D.needs_backfill(with_paths(spark, d).withColumn("width", F.col("m2_score"))).select("item_id")


@R.add("d9_labeling_pool", """
SELECT '/media/' || event_type || '/' || event_id AS path FROM events
WHERE (ts < TIMESTAMP '2024-01-20 00:00:00' OR (event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-25 10:00:00' AND TIMESTAMP '2024-01-26 19:00:00'))
  AND event_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    path = lambda i: F.concat(F.lit("/media/"), "event_type", F.lit("/"), i)
    e = table(spark, d, "events")
    files = e.select(path("event_id").alias("path"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("modified_at"))
    used = table(spark, d, "labels").join(e, F.col("doc_id") == F.col("event_id")).select(path("event_id").alias("path"))
    return D.labeling_pool(files, used, "2024-01-20 00:00:00", "click", ("2024-01-25 10:00:00", "2024-01-26 19:00:00")).select("path")


def paths_and_labels(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"))
    labels = table(spark, d, "labels").select(
        F.col("doc_id").alias("path"), F.expr("CASE WHEN toxic = 1 THEN '__skip__' WHEN quality = 1 THEN 'pixiv_public' ELSE 'not_bookmarked' END").alias("label")
    )
    return files, labels


LABELED = """labeled AS (SELECT d.doc_id AS path, CASE WHEN toxic = 1 THEN '__skip__' WHEN quality = 1 THEN 'pixiv_public' WHEN quality = 0 THEN 'not_bookmarked' END AS label
  FROM documents d LEFT JOIN labels USING (doc_id))"""


@R.add("d10_filter_label_state", f"""
WITH {LABELED} SELECT path, label, state FROM (
  SELECT path, label, 'unlabeled' AS state FROM labeled WHERE label IS NULL
  UNION ALL SELECT path, label, 'skipped' FROM labeled WHERE label = '__skip__'
  UNION ALL SELECT path, label, 'labeled' FROM labeled WHERE label = 'pixiv_public')""")
def _(spark, d):
    f, l = paths_and_labels(spark, d)
    pick = lambda s, label=None: D.filter_label_state(f, l, s, label).withColumn("state", F.lit(s))
    return pick("unlabeled").unionByName(pick("skipped")).unionByName(pick("labeled", "pixiv_public"))


@R.add("d10_label_page", f"""
WITH {LABELED} SELECT path, label FROM labeled WHERE label <> '__skip__' ORDER BY path DESC LIMIT 50 OFFSET 50""")
def _(spark, d):
    return D.label_page(*paths_and_labels(spark, d), "labeled", direction="desc", offset=50)[0]


@R.add("d11_validate_favorites", f"""
WITH {FAVORITES} SELECT item_id, len(categories) BETWEEN 1 AND 50 AND len(categories) > 4 AS valid FROM favs""")
def _(spark, d):
    f = favorites(spark, d).withColumn("isFavorited", F.size("categories") > 4)
    return D.validate_favorites(f).select("item_id", "valid")


@R.add("d12_validate_label", """
SELECT doc_id, label, CASE WHEN label = 'pixiv_public' THEN CASE WHEN doc_id % 5 BETWEEN 1 AND 3 THEN doc_id % 5 ELSE 1 END END AS rating
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'pixiv_public' WHEN 'fr' THEN 'not_bookmarked' WHEN 'de' THEN '__skip__' ELSE 'other' END AS label FROM documents)
WHERE label <> 'other'""")
def _(spark, d):
    label = F.expr("CASE lang WHEN 'en' THEN 'pixiv_public' WHEN 'fr' THEN 'not_bookmarked' WHEN 'de' THEN '__skip__' ELSE 'other' END")
    rows = table(spark, d, "documents").select("doc_id", label.alias("label"), (F.col("doc_id") % 5).alias("rating"))
    return D.validate_label(rows)


@R.add("d13_processed_by_any", f"""
WITH {MODERATED} SELECT item_id, captioned OR joycaption IS NOT NULL AS processed FROM moderated""")
def _(spark, d):
    m = moderated(spark, d).withColumn("captions", F.map_from_arrays(F.transform(F.map_keys("captions"), lambda k: F.lit("joycaption")), F.map_values("captions")))
    return D.processed_by_any(m, ["joycaption", "pixai"], ("captions", "moderations")).select("item_id", "processed")


# ---- joins -------------------------------------------------------------------------------


@R.add("e1_enrich", """
WITH l AS (SELECT * FROM (SELECT l_orderkey, l_quantity AS width, l_extendedprice AS o_totalprice,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1)
SELECT o_orderkey, o_custkey, coalesce(l.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(width, 0) AS width
FROM orders o LEFT JOIN l ON o_orderkey = l_orderkey""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("width"), F.col("l_extendedprice").alias("o_totalprice"),
        F.col("l_shipdate").alias("_at"), (-F.col("l_linenumber")).alias("_line"), (-F.col("l_partkey")).alias("_part"),
    )
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = E.enrich(o, li, "o_orderkey", ["_at", "_line", "_part"], ["width"], ["o_orderkey"])
    return out.select("o_orderkey", "o_custkey", "o_totalprice", "width")


@R.add("e1_enrich_with_posts", """
WITH t AS (SELECT o_orderkey AS item_id, o_custkey AS post_id, o_orderkey % 3 AS page,
    CASE o_orderstatus WHEN 'O' THEN 'pixiv' WHEN 'F' THEN 'danbooru' ELSE 'gelbooru' END AS type FROM orders),
  r AS (SELECT post_id, type, max(d) AS ranking_date FROM (SELECT o_custkey AS post_id, 'danbooru' AS type, o_orderdate AS d FROM orders) GROUP BY ALL)
SELECT item_id, t.type, strftime(ranking_date, '%Y-%m-%d') AS ranking_date,
  CASE WHEN t.type = 'pixiv' THEN CASE WHEN page < 2 THEN c_nationkey + page ELSE 0 END WHEN t.type = 'gelbooru' THEN c_nationkey * 10 ELSE 0 END AS width,
  CASE WHEN t.type = 'pixiv' THEN CASE WHEN page < 2 THEN 5 ELSE 0 END WHEN t.type = 'gelbooru' THEN 7 ELSE 0 END AS height
FROM t JOIN customer ON c_custkey = t.post_id LEFT JOIN r ON r.post_id = t.post_id AND r.type = t.type""")
def _(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    kind = F.when(F.col("o_orderstatus") == "O", "pixiv").when(F.col("o_orderstatus") == "F", "danbooru").otherwise("gelbooru")
    its = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("post_id"), (F.col("o_orderkey") % 3).cast("int").alias("page"), kind.alias("type"))
    rankings = o.select(F.lit("danbooru").alias("type"), F.col("o_custkey").alias("post_id"), F.col("o_orderdate").alias("ranking_date"))
    page = lambda n: F.struct((F.col("c_nationkey") + n).alias("width"), F.lit(5).alias("height"))
    pages = c.select(F.col("c_custkey").alias("post_id"), F.array(page(0), page(1)).alias("pages"))
    posts = c.select(F.lit("gelbooru").alias("type"), F.col("c_custkey").alias("post_id"), (F.col("c_nationkey") * 10).alias("post_width"), F.lit(7).alias("post_height"))
    out = E.enrich_with_posts(its, rankings, pages, posts)
    return out.select("item_id", "type", F.date_format("ranking_date", "yyyy-MM-dd").alias("ranking_date"), "width", "height")


@R.add("e2_attach_favorites", f"""
WITH {FAVORITES} SELECT c_custkey AS item_id, item_id IS NOT NULL AS "isFavorited", coalesce(array_to_string(categories, ','), '') AS categories
FROM customer LEFT JOIN favs ON c_custkey = item_id""")
def _(spark, d):
    page = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    return E.attach_favorites(page, favorites(spark, d)).withColumn("categories", F.array_join("categories", ","))


def sourceless(spark, d):
    i = items(spark, d)
    made = F.struct(F.lit("old").alias("tweetId"))
    kind = F.when(F.col("lang") == "de", "pixiv").otherwise("twitter")
    return i.select("item_id", kind.alias("type"), F.when(F.col("lang") == "fr", F.lit("twitter")).otherwise(F.concat(F.lit("twitter/"), "item_id")).alias("key"), F.when(F.col("m2_score").isNull(), made).alias("source"))


def mapping(spark, d):
    l = table(spark, d, "labels")
    return l.select(F.col("doc_id").cast("string").alias("media_id"), F.struct(F.concat(F.lit("t"), "doc_id").alias("tweetId")).alias("entry"))


BACKFILL = f"""{ITEMS}, o AS (SELECT item_id, lang, CASE WHEN lang = 'de' THEN NULL WHEN m2_score IS NULL OR lang = 'fr' THEN 'skipped'
   WHEN item_id IN (SELECT doc_id FROM labels) THEN 'updated' ELSE 'not_found' END AS outcome, m2_score IS NULL AS has FROM items)"""


@R.add("e3_backfill_source", f"""
WITH {BACKFILL} SELECT item_id, outcome, CASE WHEN outcome = 'updated' THEN 't' || item_id WHEN has THEN 'old' END AS tweet FROM o""")
def _(spark, d):
    out = E.backfill_source(sourceless(spark, d), mapping(spark, d))
    return out.select("item_id", "outcome", F.col("source.tweetId").alias("tweet"))


@R.add("e3_backfill_source_limit", f"""
WITH {BACKFILL}, u AS (SELECT item_id FROM o WHERE outcome = 'updated' ORDER BY item_id LIMIT 20)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN outcome = 'updated' AND item_id NOT IN (SELECT item_id FROM u) THEN NULL ELSE outcome END AS outcome FROM o) GROUP BY 1""")
def _(spark, d):
    return A.job_counters(E.backfill_source(sourceless(spark, d), mapping(spark, d), limit=20), F.col("outcome"))


@R.add("e4_anti_existing", """
SELECT event_id AS post_id, event_type AS type FROM events WHERE NOT (event_type = 'view' AND event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))""")
def _(spark, d):
    posts = table(spark, d, "events").select(F.col("event_id").alias("post_id"), F.col("event_type").alias("type"))
    have = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("post_id"), F.lit("view").alias("type"))
    return E.anti_existing(posts, have, ["type", "post_id"])


def stores(spark, d):
    return {
        "eva02": table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id")),
        "pixai": table(spark, d, "labels").select(F.col("doc_id").alias("item_id")),
    }


def manifest(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))


@R.add("e5_feature_coverage", """
SELECT doc_id AS item_id, 'eva02' AS feature FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT doc_id, 'pixai' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    return E.feature_coverage(manifest(spark, d), stores(spark, d))


@R.add("e5_covered_by_all", """
SELECT doc_id AS item_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) AND doc_id IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    return E.covered_by_all(manifest(spark, d), stores(spark, d))


@R.add("e6_load_features", """
SELECT doc_id AS item_id, vec_id IS NULL AS missing, 64 AS dim, coalesce(round(CAST(embedding[1] AS DOUBLE), 6), 0) AS first
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def _(spark, d):
    store = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    out = E.load_features(manifest(spark, d), store, 64)
    return out.select("item_id", "missing", F.size("vec").alias("dim"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@R.add("e7_remove_train_overlap", """
WITH t AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id))
SELECT doc_id AS item_id FROM documents WHERE sha256(text) NOT IN (SELECT h FROM t)""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("sha256"))
    train = docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("item_id")), "item_id")
    return E.remove_train_overlap(docs, train).select("item_id")


@R.add("e9_pending_downloads", """
SELECT source || '/' || doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
ORDER BY sha256('42|' || source || '/' || doc_id) LIMIT 100""")
def _(spark, d):
    name = F.concat("source", F.lit("/"), "doc_id").alias("name")
    docs = table(spark, d, "documents")
    local = docs.join(table(spark, d, "labels"), "doc_id").select(name)
    return E.pending_downloads(docs.select(name), local, 100)


@R.add("e10_without_annotation", """
SELECT event_id AS item_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 200""")
def _(spark, d):
    return E.without_annotation(moderated(spark, d), "minicpm", "joycaption", 200, "moderations").select("item_id")


# ---- aggregates --------------------------------------------------------------------------


@R.add("f1_daily_counts", f"""
WITH {ITEMS} SELECT date, count(*) AS n FROM items WHERE status = 'inferred' AND date LIKE '2024-01%' GROUP BY 1""")
def _(spark, d):
    return A.daily_counts(items(spark, d), "2024-01")


@R.add("f2_counts_by_type", """
SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'error') AS error
FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-10'""")
def _(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("type"))
    return A.counts_by_type(e, "2024-01-10", ["click", "view", "error"])


@R.add("f3_provider_stats", f"""
WITH {MODERATED}, r AS (SELECT 'minicpm' AS provider, minicpm AS v FROM moderated UNION ALL SELECT 'joycaption', joycaption FROM moderated)
SELECT provider, count(v) AS n, CAST(sum(v) AS DOUBLE) AS total, round(sum(v) / count(v), 2) AS mean FROM r GROUP BY 1""")
def _(spark, d):
    return A.provider_stats(moderated(spark, d))


@R.add("f4_duplicate_groups", """
WITH h AS (SELECT doc_id AS key, sha256(text) AS sha256 FROM documents), g AS (SELECT sha256, count(*) AS n FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT sha256, key, n FROM h JOIN g USING (sha256)""")
def _(spark, d):
    return A.duplicate_groups(table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("sha256")))


@R.add("f5_group_sizes", f"""
WITH {PU_LABELS}, g AS (SELECT artwork_id, count(*) AS s FROM pu WHERE artwork_id IS NOT NULL GROUP BY 1)
SELECT item_id, s AS artwork_group_size, round(CASE WHEN s > 1 THEN 1.0 / s ELSE 1 END, 6) AS group_weight FROM pu LEFT JOIN g USING (artwork_id)""")
def _(spark, d):
    return A.group_sizes(pu_labels(spark, d)).select("item_id", "artwork_group_size", F.round("group_weight", 6).alias("group_weight"))


@R.add("f6_split_summary", """
SELECT lang AS label, count(*) FILTER (source IN ('src1', 'src2')) AS val, count(*) FILTER (source = 'src3') AS test,
       count(*) FILTER (source NOT IN ('src1', 'src2', 'src3')) AS train, count(*) AS total FROM documents GROUP BY 1""")
def _(spark, d):
    split = F.when(F.col("source").isin("src1", "src2"), "val").when(F.col("source") == "src3", "test").otherwise("train")
    return A.split_summary(table(spark, d, "documents").select(F.col("lang").alias("label"), split.alias("split")))


@R.add("f7_eval_summary", f"""
WITH {PU_LABELS}, s AS (SELECT label, split_part(file_path, '/', 3) AS source, CAST(rating AS VARCHAR) AS rating FROM pu)
SELECT 'label' AS facet, label AS value, count(*) AS n FROM s GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM s GROUP BY 2
UNION ALL SELECT 'rating', rating, count(*) FROM s GROUP BY 2""")
def _(spark, d):
    return A.eval_summary(pu_labels(spark, d).withColumn("source", F.split("file_path", "/")[2]))


@R.add("f7_artwork_summary", f"""
WITH {PU_LABELS}, g AS (SELECT artwork_id, count(*) AS n FROM pu WHERE artwork_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS artworks, count(*) FILTER (n > 1) AS multi_page, coalesce(max(n), 0) AS largest FROM g""")
def _(spark, d):
    return A.artwork_summary(pu_labels(spark, d))


@R.add("f8_label_progress", f"""
WITH {LABELED} SELECT count(*) AS total, count(*) FILTER (label <> '__skip__') AS labeled, count(*) FILTER (label = '__skip__') AS skipped,
  count(*) FILTER (label IS NULL) AS remaining FROM labeled""")
def _(spark, d):
    return A.label_progress(*paths_and_labels(spark, d))


@R.add("f9_class_prior", f"""
WITH {PU_LABELS} SELECT round(count(*) FILTER (label = 'pos_a') / count(*), 6) AS pi FROM pu WHERE label IN ('pos_a', 'unlabeled')""")
def _(spark, d):
    return A.class_prior(pu_labels(spark, d).withColumn("split", F.lit("train")), "pos_a").withColumn("pi", F.round("pi", 6))


@R.add("f10_category_distribution", """
SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, d):
    return A.category_distribution(table(spark, d, "orders").select(F.col("o_orderpriority").alias("category")))


USAGE = """usage AS (SELECT 'grok-' || (conv_id % 2) AS model, CASE WHEN role = 'user' THEN length(text) END AS prompt,
  CASE WHEN role = 'assistant' THEN length(text) END AS completion, length(text) AS total, CASE WHEN role = 'system' THEN turn + 1 END AS reasoning FROM conversations)"""


@R.add("f11_usage_cost", f"""
WITH {USAGE}, s AS (SELECT model, sum(prompt) AS p, sum(completion) AS c, sum(total) AS t, coalesce(sum(reasoning), 0) AS r FROM usage GROUP BY 1)
SELECT model, CAST(p AS BIGINT) AS prompt, CAST(c AS BIGINT) AS completion, CAST(t AS BIGINT) AS total, CAST(r AS BIGINT) AS reasoning,
  round(p * 0.2 / 1000000, 8) AS input_cost, round((c + r) * 0.5 / 1000000, 8) AS output_cost, round(p * 0.2 / 1000000 + (c + r) * 0.5 / 1000000, 8) AS total_cost FROM s""")
def _(spark, d):
    size = F.length("text")
    log = table(spark, d, "conversations").select(
        F.concat(F.lit("grok-"), F.col("conv_id") % 2).alias("model"), F.when(F.col("role") == "user", size).alias("prompt"),
        F.when(F.col("role") == "assistant", size).alias("completion"), size.alias("total"), F.when(F.col("role") == "system", F.col("turn") + 1).alias("reasoning"),
    )
    out = A.usage_cost(log)
    return out.select(*[F.round(c, 8).alias(c) if c.endswith("cost") else F.col(c) for c in out.columns])


@R.add("f12_page_count", f"""
WITH {MODERATED} SELECT 'minicpm' AS provider, CAST(ceil(count(minicpm) / 50.0) AS BIGINT) AS pages FROM moderated
UNION ALL SELECT 'joycaption', CAST(ceil(count(joycaption) / 50.0) AS BIGINT) FROM moderated""")
def _(spark, d):
    return A.page_count(A.provider_stats(moderated(spark, d))).select("provider", "pages")


@R.add("f13_median_score_by_rating", f"""
WITH {ITEMS}, {PU_LABELS}, {scored_sql()} SELECT model, rating, count(*) AS n, round(median(score), 4) AS median FROM scored
WHERE rating IN (1, 2, 3) GROUP BY ALL""")
def _(spark, d):
    return A.median_score_by_rating(scored(spark, d))


@R.add("f14_job_counters", f"""
WITH {MODERATED} SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN captioned THEN 'skipped' ELSE 'updated' END AS outcome, count(*) AS n FROM moderated GROUP BY 1""")
def _(spark, d):
    outcome = F.when(F.col("event_type") == "error", "error").when(F.size("captions") > 0, "skipped").otherwise("updated")
    return A.job_counters(moderated(spark, d), outcome)
