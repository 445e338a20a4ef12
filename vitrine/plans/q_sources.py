"""Queries for sources, sinks and key functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.functions import bands, keys
from vitrine.operators.scale import shared_folder
from vitrine.plans.fixtures import ITEMS, PU_LABELS, Registry, items, pu_labels, table
from vitrine.sources import landing, sinks

R = Registry()

# ---- sources -----------------------------------------------------------------------------


def landed(spark, d):
    """Events as landed pages of 50 posts; a page that starts with an error event failed."""
    post = F.struct(
        F.col("event_id").alias("id"),
        F.concat(F.lit("https://cdn.example/"), "event_type", F.lit("/"), "event_id", F.lit(".jpg")).alias("file_url"),
        F.col("ts").cast("string").alias("created_at"),
    )
    pages = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(post)).alias("posts"), F.min_by("event_type", "event_id").alias("first")
    )
    return pages.select("page", F.when(F.col("first") == "error", 500).otherwise(200).alias("status"), F.to_json("posts").alias("body"))


@R.add("a1_read_posts", """
WITH p AS (SELECT event_id, event_type, event_id // 50 AS page,
       first_value(event_type) OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS f,
       row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS i FROM events)
SELECT event_id AS post_id, 'https://cdn.example/' || event_type || '/' || event_id || '.jpg' AS url, page, i AS "index"
FROM p WHERE f <> 'error'""")
def _(spark, d):
    return landing.posts_of_pages(landed(spark, d), "danbooru").select("post_id", "url", "page", "index")


PLACED = """p AS (SELECT event_id, event_type, ts, value, event_id // 50 AS page,
       first_value(event_type) OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS f,
       row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS i FROM events)"""


def landed_as(spark, d, provider):
    """The landed pages in the layout of another provider."""
    pages = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).cast("int").alias("page"))
    at = F.col("ts").cast("timestamp")
    url = F.concat(F.lit("https://cdn.example/"), "event_type", F.lit("/"), "event_id", F.lit(".jpg?1"))
    post = {
        "gelbooru": F.struct(F.col("event_id").alias("id"), url.alias("file_url"), F.date_format(at, "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at")),
        "sankaku": F.struct(F.col("event_id").alias("id"), url.alias("file_url"), F.struct(F.unix_timestamp(at).alias("s")).alias("created_at")),
        "pixiv": F.struct(F.col("event_id").alias("illust_id"), url.alias("url"), (F.col("event_id") % 3).cast("string").alias("illust_page_count")),
    }[provider]
    posts = pages.agg(F.array_sort(F.collect_list(post)).alias("posts"), F.min_by("event_type", "event_id").alias("first"))
    body = {"gelbooru": F.struct(F.col("posts").alias("post")), "sankaku": F.struct(F.col("posts").alias("data"))}.get(
        provider, F.struct(F.col("posts").alias("contents"), F.date_format(F.date_add(F.lit("2024-01-01"), F.col("page") % 28), "yyyyMMdd").alias("date"))
    )
    return posts.select(
        "page", F.when(F.col("first") == "error", 500).otherwise(200).alias("status"), F.to_json(body).alias("body"), F.lit("daily").alias("mode")
    )


def dated_posts(spark, d, provider):
    posts = landing.posts_of_pages(landed_as(spark, d, provider), provider)
    date = landing.post_date(provider, F.col("asked"), F.col("created_at"))
    return posts.select("post_id", "page", "index", date.alias("date"), keys.item_key(provider, F.col("post_id"), F.col("url")).alias("key"))


BORN = "strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d')"


@R.add("a1_read_gelbooru", f"""
WITH {PLACED} SELECT event_id AS post_id, page, i AS "index", {BORN} AS date, CAST(NULL AS VARCHAR) AS key FROM p WHERE f <> 'error'""")
def _(spark, d):
    return dated_posts(spark, d, "gelbooru")


@R.add("a1_read_sankaku", f"""
WITH {PLACED} SELECT event_id AS post_id, page, i AS "index", {BORN} AS date, 'sankaku/' || event_id || '.jpg' AS key FROM p WHERE f <> 'error'""")
def _(spark, d):
    return dated_posts(spark, d, "sankaku")


def artworks(spark, d):
    """Files of the events as artworks: one of two, so that some posts name more than there are."""
    file = lambda n: F.struct(F.struct(F.concat(F.lit("https://i.example/"), "event_id", F.lit(f"_p{n}.png")).alias("original")).alias("urls"))
    return table(spark, d, "events").where("event_type <> 'click'").select(F.col("event_id").alias("post_id"), F.array(file(0)).alias("pages"))


@R.add("a1_artwork_pages", f"""
WITH {PLACED}, n AS (SELECT *, unnest(range(greatest(event_id % 3, 1))) AS k FROM p WHERE f <> 'error')
SELECT event_id AS post_id, CAST(k AS INT) AS artwork_page, strftime(DATE '2024-01-01' + CAST(page % 28 AS INT), '%Y-%m-%d') AS date,
       CASE WHEN k = 0 AND event_type <> 'click' THEN 'pixiv/' || event_id || '_p0.png' END AS key FROM n""")
def _(spark, d):
    posts = landing.posts_of_pages(landed_as(spark, d, "pixiv"), "pixiv")
    date = landing.post_date("pixiv", F.col("asked"), F.col("created_at")).alias("date")
    key = keys.item_key("pixiv", F.col("post_id"), F.col("url")).alias("key")
    return landing.expand_pages(posts, artworks(spark, d)).select("post_id", "artwork_page", date, key)


@R.add("a1_rejected_pages", """
SELECT event_id // 50 AS page FROM events GROUP BY 1 HAVING arg_min(event_type, event_id) = 'error'""")
def _(spark, d):
    return landing.rejected_pages(landed(spark, d), "danbooru").select("page")


EXT = "CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.PNG' WHEN 'de' THEN '.txt' ELSE '' END"


@R.add("a2_media_files", f"""
SELECT '/media/' || source || '/' || doc_id || {EXT} AS path, 'archive/' || doc_id AS item_id
FROM documents WHERE coalesce(lang, '') <> 'de'""")
def _(spark, d):
    paths = table(spark, d, "documents").select(
        F.concat(F.lit("/media/"), "source", F.lit("/"), "doc_id", F.expr(EXT)).alias("path")
    )
    return landing.media_files(paths, "archive", bare_names=True)


@R.add("a2_scan_folder", """
SELECT source, sum(strlen(text) + 1) AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY source""")
def _(spark, d):
    # the texts as files, a line feed after each; files of other kinds lie beside them
    out = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    docs.select("source", "text").write.partitionBy("source").text(f"{out}/texts")
    docs.select("doc_id", "source").write.partitionBy("source").csv(f"{out}/others")
    files = landing.scan_media(spark, out, "archive", extensions=[".txt"])
    source = F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")
    return files.groupBy(source).agg(F.sum("length").alias("n_bytes"))


@R.add("a3_manual_labels", f"""
WITH {PU_LABELS} SELECT file_path AS path, label, rating FROM pu WHERE label <> 'unlabeled'""")
def _(spark, d):
    plain = F.to_json(F.create_map("file_path", "label"))
    rated = F.to_json(F.create_map("file_path", F.struct("label", "rating")))
    texts = pu_labels(spark, d).select(F.when(F.col("rating").isNull(), plain).otherwise(rated).alias("value"))
    return landing.manual_labels(texts, "value", ["pos_a", "pos_b", "not_bookmarked"])


@R.add("a4_feature_rows", """
SELECT vec_id AS item_id, len(embedding) AS dim,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    store = e.withColumn("feature_name", F.explode(F.array(F.lit("eva02"), F.lit("pixai"))))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return landing.feature_rows(store, "eva02").select("item_id", F.size("vec").alias("dim"), F.round(total, 6).alias("total"))


@R.add("a5_import_collection", """
SELECT event_id, epoch_us(ts) AS created_us, epoch_us(ts) AS last_us, event_type FROM events""")
def _(spark, d):
    # the given times have no zone: read them as UTC whatever the session's zone is
    us = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    stamp = F.struct(F.floor(us / 1_000_000).alias("seconds"), (F.pmod(us, F.lit(1_000_000)) * 1000).alias("nanoseconds"))
    raw = table(spark, d, "events").select(
        "event_id", "event_type", stamp.alias("created"), F.struct(F.array(stamp).alias("history")).alias("meta")
    )
    return landing.import_collection(raw).select(
        "event_id",
        F.unix_micros("created").alias("created_us"),
        F.unix_micros(F.col("meta.history")[0]).alias("last_us"),
        "event_type",
    )


def archive(spark, d):
    """Conversation turns as typed archive entries: two media each, the newer list on user turns."""
    s = lambda c: F.struct(c.alias("S"))
    m = lambda c: F.struct(c.alias("M"))
    name = lambda n: F.concat(F.lit("http://pbs.example/media/"), "conv_id", F.lit(f"-{n}.jpg"))
    one = lambda n: m(F.struct(s(F.concat(F.lit("https"), F.substring(name(n), 5, 200))).alias("media_url_https"), s(name(n)).alias("media_url")))
    media = lambda *ns: m(F.struct(F.struct(F.array(*[one(n) for n in ns]).alias("L")).alias("media")))
    user = F.col("role") == "user"
    return table(spark, d, "conversations").select(
        s(F.concat_ws("-", "conv_id", "turn")).alias("id_str"),
        F.when(user, s(F.col("text"))).alias("full_text"),
        s(F.upper("role")).alias("text"),
        s(F.lpad("turn", 6, "0")).alias("created_at"),
        F.when(F.col("role") == "system", m(F.struct(s(F.lit("bot")).alias("screen_name"), s(F.lit("Bot")).alias("name"), s(F.lit("7")).alias("id_str")))).alias("user"),
        s(F.col("role")).alias("user_id_str"),
        F.when(user, media(1, 2)).alias("extended_entities"),
        media(1).alias("entities"),
    )


def entries(spark, d):
    text = archive(spark, d).select(F.to_json(F.struct("*")).alias("v"))
    return landing.media_entries(text.select(F.from_json("v", landing.ARCHIVE_SCHEMA).alias("r")).select("r.*"))


@R.add("a6_media_entries", """
SELECT conv_id || '-' || turn AS id_str, CASE WHEN role = 'user' THEN text END AS full_text, upper(role) AS text,
       CASE WHEN role = 'system' THEN 'bot' END AS screen_name, role AS user_id_str,
       CASE WHEN role = 'user' THEN 2 ELSE 0 END AS n_extended,
       'https://pbs.example/media/' || conv_id || '-1.jpg' AS first_url FROM conversations""")
def _(spark, d):
    return entries(spark, d).select(
        "id_str",
        "full_text",
        "text",
        F.col("user.screen_name").alias("screen_name"),
        "user_id_str",
        F.coalesce(F.array_size("extended_media"), F.lit(0)).alias("n_extended"),
        F.col("media")[0]["media_url_https"].alias("first_url"),
    )


@R.add("a7_tag_vocabulary", """
SELECT CAST(c_custkey AS INT) AS idx, c_name AS tag,
       CASE WHEN c_custkey < 1000 THEN 'feature' ELSE 'character' END AS kind FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer").select(F.to_json(F.create_map("c_name", "c_custkey")).alias("value"))
    return landing.tag_vocabulary(c, 1000)


@R.add("a7_char_ip_map", """
SELECT c_name AS tag, 'ip' || (c_custkey % 3) AS ip FROM customer
UNION ALL SELECT c_name, 'jp' || (c_custkey % 5) FROM customer""")
def _(spark, d):
    ip = lambda p, n: F.concat(F.lit(p), F.col("c_custkey") % n)
    c = table(spark, d, "customer").select(F.to_json(F.create_map("c_name", F.array(ip("ip", 3), ip("jp", 5)))).alias("value"))
    return landing.char_ip_map(c)


KEY_PARTS = """
(CASE doc_id % 4 WHEN 0 THEN 'deepdanbooru' WHEN 1 THEN 'eva02' WHEN 2 THEN 'pixai' ELSE 'resnet' END) || '_' ||
(CASE lang WHEN 'en' THEN 'pixiv_public' WHEN 'fr' THEN 'pixiv_private' WHEN 'de' THEN 'twitter' ELSE 'all' END) || '_' ||
(CASE doc_id % 3 WHEN 0 THEN 'elkan_noto' WHEN 1 THEN 'biased_svm' ELSE 'nnpu' END)"""
MODEL_RE = "^(deepdanbooru|eva02|pixai)_(pixiv_public|pixiv_private|twitter)_(elkan_noto|biased_svm|nnpu)$"


@R.add("a8_parse_model_key", f"""
WITH m AS (SELECT doc_id, {KEY_PARTS} AS model FROM documents)
SELECT doc_id, regexp_extract(model, '{MODEL_RE}', 1) AS feature, regexp_extract(model, '{MODEL_RE}', 2) AS model_label,
       regexp_extract(model, '{MODEL_RE}', 3) AS method FROM m
WHERE regexp_matches(model, '{MODEL_RE}') AND regexp_extract(model, '{MODEL_RE}', 3) <> 'nnpu'""")
def _(spark, d):
    models = table(spark, d, "documents").select("doc_id", F.expr(KEY_PARTS).alias("model"))
    return landing.parse_model_key(models, methods=["elkan_noto", "biased_svm"]).drop("model")


# ---- sinks -------------------------------------------------------------------------------


@R.add("b1_upsert", """
WITH u AS (SELECT * FROM (
  SELECT o_custkey + 100 AS c_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS c_acctbal, o_orderkey AS last_order,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1)
SELECT c_custkey, c.c_name, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal, u.last_order
FROM customer c FULL JOIN u USING (c_custkey)""")
def _(spark, d):
    target = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    updates = table(spark, d, "orders").select(
        (F.col("o_custkey") + 100).alias("c_custkey"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("c_acctbal"),
        F.col("o_orderkey").alias("last_order"),
        "o_orderdate",
    )
    return sinks.upsert(target, updates, ["c_custkey"], [F.col("o_orderdate"), F.col("last_order")]).drop("o_orderdate")


@R.add("b2_merge_map", f"""
WITH {ITEMS} SELECT item_id, CASE WHEN vec IS NULL THEN 1 WHEN m2_score IS NULL THEN 2 ELSE 3 END AS n_models, CAST(file_size AS DOUBLE) AS m1, round(m2_score, 6) AS m2 FROM items""")
def _(spark, d):
    new = F.create_map(F.lit("score"), F.col("file_size").cast("double"))
    merged = sinks.merge_map(items(spark, d), "inferences", F.lit("m1"), new)
    at = lambda m: F.try_element_at(F.try_element_at("inferences", F.lit(m)), F.lit("score"))
    return merged.select("item_id", F.size("inferences").alias("n_models"), at("m1").alias("m1"), F.round(at("m2"), 6).alias("m2"))


@R.add("b3_append_missing", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    return sinks.append_missing(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"])


AXES64 = {"eva02": (0, 64), "character": (0, 16), "situation": (16, 32), "style": (32, 64)}


def points(spark, d):
    i = items(spark, d)
    cut = {a: F.slice("vec", lo + 1, hi - lo) for a, (lo, hi) in AXES64.items()}
    return sinks.vector_points(i.withColumns({f"v_{a}": c for a, c in cut.items()}), {a: f"v_{a}" for a in cut})


POINTS = """
points AS (
  SELECT item_id, date, type, status, axis, v, sqrt(list_dot_product(v, v)) AS norm FROM (
    SELECT item_id, date, type, status, a.axis AS axis,
           list_transform(vec[a.lo + 1 : a.hi], lambda x: CAST(x AS DOUBLE)) AS v
    FROM items, (VALUES ('eva02', 0, 64), ('character', 0, 16), ('situation', 16, 32), ('style', 32, 64)) a(axis, lo, hi) WHERE vec IS NOT NULL))"""


@R.add("b4_vector_points", f"""
WITH {ITEMS}, {POINTS} SELECT item_id, axis, round(norm, 6) AS norm, len(v) AS dim, date, type, status FROM points""")
def _(spark, d):
    return points(spark, d).select("item_id", "axis", F.round("norm", 6).alias("norm"), F.size("vec").alias("dim"), "date", "type", "status")


@R.add("b4_upsert_vectors", f"""
WITH {ITEMS} SELECT item_id, 'eva02' AS axis, CASE WHEN item_id % 3 = 0 THEN '2025-01-01' WHEN item_id % 5 = 0 THEN NULL ELSE date END AS date,
       CASE WHEN item_id % 3 = 0 THEN 'pending' ELSE status END AS status, len(vec) AS dim FROM items WHERE vec IS NOT NULL""")
def _(spark, d):
    """Two writes: everything, some without a date, then a third of it under another date."""
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    first = items(spark, d).withColumn("date", F.when(F.col("item_id") % 5 > 0, F.col("date")))
    sinks.upsert_vectors(first, {"eva02": "vec"}, path)
    moved = first.where("item_id % 3 = 0").withColumns({"date": F.lit("2025-01-01"), "status": F.lit("pending")})
    sinks.upsert_vectors(moved, {"eva02": "vec"}, path)
    return spark.read.parquet(path).select("item_id", "axis", F.col("date").cast("string").alias("date"), "status", F.size("vec").alias("dim"))


@R.add("b5_replace_by_key", """
WITH e AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
     w AS (SELECT d.source, count(*) AS labelled FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY ALL)
SELECT source, lang, n, NULL::BIGINT AS labelled FROM e WHERE source NOT IN (SELECT source FROM w)
UNION ALL SELECT source, NULL, NULL, labelled FROM w""")
def _(spark, d):
    docs = table(spark, d, "documents")
    old = docs.groupBy("source", "lang").agg(F.count("*").alias("n"))
    new = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("labelled"))
    return sinks.replace_by_key(old, new, ["source"])


@R.add("b6_append_metrics", """
SELECT source, count(*) AS n, NULL::DOUBLE AS mean_chars FROM documents GROUP BY 1
UNION ALL SELECT lang, NULL, round(avg(n_chars), 4) FROM documents GROUP BY 1""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return sinks.append_metrics(
        docs.groupBy("source").agg(F.count("*").alias("n")),
        docs.groupBy(F.col("lang").alias("source")).agg(F.round(F.avg("n_chars"), 4).alias("mean_chars")),
    )


def keyed_documents(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        F.expr("CASE WHEN source = 'src3' THEN 'docs/' ELSE 'docs/' || doc_id || '.jpg' END").alias("key"),
        F.expr("CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 7919) % 100000 END").alias("created_at"),
    )


KEYED = """k AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 'docs/' ELSE 'docs/' || doc_id || '.jpg' END AS key,
  CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 7919) % 100000 END AS created_at FROM documents)"""
ANCHOR = "docs/40.jpg"


@R.add("b7_delete_from_anchor", f"""
WITH {KEYED} SELECT doc_id, key, created_at FROM k
WHERE created_at >= (SELECT min(created_at) FROM k WHERE key = '{ANCHOR}') AND key <> 'docs/'""")
def _(spark, d):
    return sinks.delete_from_anchor(keyed_documents(spark, d), ANCHOR)


@R.add("b7_keep_before_anchor", f"""
WITH {KEYED} SELECT doc_id, key, created_at FROM k
WHERE NOT coalesce(created_at >= (SELECT min(created_at) FROM k WHERE key = '{ANCHOR}') AND key <> 'docs/', false)""")
def _(spark, d):
    return sinks.keep_before_anchor(keyed_documents(spark, d), ANCHOR)


def favorites(spark, d):
    """Distinct order priorities per customer, five at most."""
    cats = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("categories"))
    return cats.select(F.col("o_custkey").alias("item_id"), F.lit(True).alias("isFavorited"), "categories")


FAVORITES = """favs AS (SELECT o_custkey AS item_id, list_sort(list(DISTINCT o_orderpriority)) AS categories FROM orders GROUP BY 1)"""


@R.add("b8_array_union_ref", f"""
WITH {FAVORITES} SELECT item_id, array_to_string(list_sort(list_distinct(list_append(categories, '3-MEDIUM'))), ',') AS refs FROM favs""")
def _(spark, d):
    out = sinks.array_union_ref(favorites(spark, d), "categories", F.lit("3-MEDIUM"))
    return out.select("item_id", F.array_join(F.array_sort("categories"), ",").alias("refs"))


# ---- keys, dates, URLs -------------------------------------------------------------------


@R.add("c1_project_public", """
SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS nested_at, value FROM events""")
def _(spark, d):
    raw = table(spark, d, "events").select(
        F.col("event_id").alias("_id"), F.col("ts").alias("created_at"), F.struct(F.col("ts").alias("at")).alias("meta"),
        "value", F.lit("/x").alias("localPath"), F.lit(1).alias("topTagProbs"),
    )
    out = keys.project_public(raw)
    return out.select(*[c for c in out.columns if c != "meta"], F.col("meta.at").alias("nested_at"))


@R.add("c2_resolve_path", f"""
WITH {ITEMS} SELECT item_id, round(m2_score, 6) AS value FROM items""")
def _(spark, d):
    i = items(spark, d)
    return i.select("item_id", F.round(keys.resolve_path(i, "inferences.m2.score"), 6).alias("value"))


URL = """CASE WHEN lang = 'es' THEN NULL ELSE 'http://cdn.example/' || source || '/' || doc_id ||
(CASE doc_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.webp' WHEN 3 THEN '.png?x=1' ELSE '' END) END"""


@R.add("c3_item_key", f"""
WITH u AS (SELECT doc_id, {URL} AS url FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND url IS NOT NULL THEN 'danbooru/' || doc_id || '.jpg' END AS plain_key,
       CASE WHEN url IS NOT NULL THEN CASE doc_id % 5 WHEN 0 THEN 'sankaku/' || doc_id || '.jpg' WHEN 2 THEN 'sankaku/' || doc_id || '.webp'
            WHEN 3 THEN 'sankaku/' || doc_id || '.png' END END AS loose_key FROM u""")
def _(spark, d):
    u = table(spark, d, "documents").select("doc_id", F.expr(URL).alias("url"))
    return u.select(
        "doc_id",
        keys.item_key("danbooru", F.col("doc_id"), F.col("url")).alias("plain_key"),
        keys.item_key("sankaku", F.col("doc_id"), F.col("url")).alias("loose_key"),
    )


@R.add("c4_bucket_date", """
SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS date,
       strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC' + INTERVAL 9 HOUR, '%Y-%m-%d') AS epoch_date FROM events""")
def _(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        "event_id",
        keys.bucket_date(ts).alias("date"),
        keys.bucket_date(F.timestamp_seconds(F.floor(F.unix_micros(ts) / 1_000_000))).alias("epoch_date"),
    )


@R.add("c5_target_date", """
SELECT event_id, strftime(ts + INTERVAL 9 HOUR - INTERVAL 2 DAY, '%Y-%m-%d') AS ranking,
       strftime(ts + INTERVAL 4 HOUR - INTERVAL 10 DAY, '%Y-%m-%d') AS backfill FROM events""")
def _(spark, d):
    now = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        "event_id", keys.target_date(now, 2).alias("ranking"), keys.target_date(now, 3 + 7, hours=5).alias("backfill")
    )


PATHS = """CASE WHEN lang = 'de' THEN '/tmp/' || doc_id || '.jpg' WHEN lang = 'es' THEN '/media/images/' || doc_id || '.png'
ELSE '/media/images/' || source || '/' || doc_id || '_p' || (doc_id % 3) || '.jpg' END"""


@R.add("c6_path_to_id", f"""
WITH p AS (SELECT doc_id, lang, source, {PATHS} AS path FROM documents)
SELECT doc_id, CASE WHEN lang IN ('de', 'es') THEN CAST(doc_id AS VARCHAR) ELSE 'cat_' || source || '/' || doc_id || '_p' || (doc_id % 3) END AS item_id,
       CASE WHEN lang = 'de' THEN 'unknown' WHEN lang = 'es' THEN doc_id || '.png' ELSE source END AS source,
       CASE WHEN lang NOT IN ('de', 'es') THEN CAST(doc_id AS VARCHAR) END AS artwork_id FROM p""")
def _(spark, d):
    path, root = F.expr(PATHS), "/media/images"
    return table(spark, d, "documents").select(
        "doc_id",
        keys.path_to_id(path, root, "cat_").alias("item_id"),
        keys.path_to_source(path, root).alias("source"),
        keys.artwork_id(keys.stem(path)).alias("artwork_id"),
    )


@R.add("c7_escape_keys", """
SELECT page_id, replace(replace(replace(url || '%', '%', '%25'), '/', '%2F'), '.', '%2E') AS escaped,
       translate(url || '$', '.$', '__') AS sanitized, url_encode(url || ' *~') AS quoted FROM pages""")
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        keys.escape_key(F.concat(u, F.lit("%"))).alias("escaped"),
        keys.sanitize_key(F.concat(u, F.lit("$"))).alias("sanitized"),
        keys.quote_key(F.concat(u, F.lit(" *~"))).alias("quoted"),
    )


@R.add("c8_uuid5", """
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || CAST(doc_id AS VARCHAR)::BLOB) AS s FROM documents)
SELECT doc_id, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' ||
       substr('89ab', (instr('0123456789abcdef', s[17]) - 1) % 4 + 1, 1) || s[18:20] || '-' || s[21:32] AS uuid FROM h""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.uuid5(F.col("doc_id").cast("string")).alias("uuid"))


SOURCE = """CASE lang WHEN 'en' THEN 'https://i.pximg.net/img-original/img/2024/' || doc_id || '_p0.jpg'
WHEN 'fr' THEN 'https://x.example/' || doc_id || '_p0.jpg' WHEN 'de' THEN '' END"""


@R.add("c9_canonical_source_url", f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN 'https://www.pixiv.net/artworks/' || doc_id ELSE {SOURCE} END AS source FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.canonical_source_url(F.expr(SOURCE)).alias("source"))


PAGE_KEY = """CASE doc_id % 7 WHEN 0 THEN 'pixiv/' || doc_id || '_p1.jpg' WHEN 1 THEN 'pixiv/' || doc_id || '-0123456789abcdef0123456789abcdef_p12.png'
WHEN 2 THEN 'sankaku/' || doc_id || '.jpg' WHEN 3 THEN 'twitter/' || doc_id WHEN 4 THEN 'danbooru/' || doc_id || '.webp'
WHEN 5 THEN 'gelbooru/' || doc_id || '.gif' ELSE 'pixiv' END"""
TWEET = "CASE WHEN lang = 'en' THEN '9' || doc_id END"


@R.add("c10_provider_page_url", f"""
SELECT doc_id, CASE WHEN doc_id % 7 < 2 THEN 'https://www.pixiv.net/artworks/' || doc_id
  WHEN doc_id % 7 = 2 THEN 'https://chan.sankakucomplex.com/ja/posts/' || doc_id
  WHEN doc_id % 7 = 3 THEN 'https://twitter.com/i/web/status/' || ({TWEET})
  WHEN doc_id % 7 = 4 THEN 'https://danbooru.donmai.us/posts/' || doc_id
  WHEN doc_id % 7 = 5 THEN 'https://gelbooru.com/index.php?page=post&s=view&id=' || doc_id END AS url FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.provider_page_url(F.expr(PAGE_KEY), F.expr(TWEET)).alias("url"))


@R.add("c11_media_id", r"""
SELECT page_id, nullif(regexp_extract(url, '^https?://[^/?#]+/(?:[^?#]*/)?([^/?#]*)', 1), '') AS from_url,
       nullif(split_part(replace(url, '//', ''), '/', 2), '') AS from_key FROM pages""")
def _(spark, d):
    key = F.replace("url", F.lit("//"), F.lit(""))
    return table(spark, d, "pages").select(
        "page_id", keys.media_id_from_url(F.col("url")).alias("from_url"), keys.media_id_from_key(key).alias("from_key")
    )


@R.add("c12_bands", """
WITH v AS (SELECT event_id, (event_id % 101) / 100.0 AS s, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS INT) // 10 END AS r FROM events)
SELECT event_id, CASE WHEN s >= 0.8 THEN 'purple' WHEN s >= 0.6 THEN 'blue' WHEN s >= 0.4 THEN 'green' WHEN s >= 0.2 THEN 'yellow' ELSE 'gray' END AS score_band,
  CASE WHEN r IS NULL THEN 'Unknown' WHEN r <= 2 THEN 'Safe' WHEN r <= 4 THEN 'Slightly Suggestive' WHEN r <= 6 THEN 'Sensitive' WHEN r <= 8 THEN 'Adult' ELSE 'Explicit' END AS rating_band FROM v""")
def _(spark, d):
    score = F.col("event_id") % 101 / 100
    rating = F.when(F.col("event_type") != "error", F.expr("CAST(get_json_object(props, '$.k') AS INT) DIV 10"))
    return table(spark, d, "events").select("event_id", bands.score_band(score).alias("score_band"), bands.rating_band(rating).alias("rating_band"))


@R.add("c13_rank_weight", """
WITH r AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_id % 50 + 1 END AS k, 50 AS t FROM events)
SELECT event_id, coalesce(round(pow((t - k + 1) / t, 15) * 100, 6), 0) AS weight,
  CASE WHEN k IS NULL THEN 'gray' WHEN 1 - pow(1 - k / t, 15) <= 0.2 THEN 'purple' WHEN 1 - pow(1 - k / t, 15) <= 0.4 THEN 'blue'
       WHEN 1 - pow(1 - k / t, 15) <= 0.6 THEN 'green' WHEN 1 - pow(1 - k / t, 15) <= 0.8 THEN 'yellow' ELSE 'gray' END AS band FROM r""")
def _(spark, d):
    rank, total = F.when(F.col("event_type") != "error", F.col("event_id") % 50 + 1), F.lit(50)
    return table(spark, d, "events").select(
        "event_id", F.round(bands.rank_weight(rank, total), 6).alias("weight"), bands.rank_band(rank, total).alias("band")
    )


@R.add("c14_count_intensity", """
WITH n AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) * 200 AS n FROM lineitem GROUP BY 1)
SELECT date, n, round(least(n / greatest(max(n) OVER (PARTITION BY date[1:7]), 10000), 1), 6) AS intensity FROM n""")
def _(spark, d):
    days = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")).agg((F.count("*") * 200).alias("n"))
    return bands.count_intensity(days).withColumn("intensity", F.round("intensity", 6))


@R.add("c15_aspect_ratio", """
SELECT doc_id, CASE WHEN n_chars > 0 AND doc_id > 0 THEN round(least(greatest(n_chars / doc_id, 0.5), 2), 6) END AS ratio FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(bands.aspect_ratio(F.col("n_chars"), F.col("doc_id")), 6).alias("ratio"))


PROVIDER = "CASE doc_id % 4 WHEN 0 THEN 'danbooru' WHEN 1 THEN 'gelbooru' WHEN 2 THEN 'sankaku' ELSE 'pixiv' END"
CODE = "CASE lang WHEN 'en' THEN 's' WHEN 'fr' THEN 'general' WHEN 'de' THEN 'q' ELSE 'g' END"


@R.add("c16_provider_rating_label", f"""
WITH x AS (SELECT doc_id, {PROVIDER} AS p, {CODE} AS c FROM documents)
SELECT doc_id, CASE WHEN p = 'danbooru' THEN CASE c WHEN 's' THEN 'Sensitive' WHEN 'q' THEN 'Questionable' WHEN 'g' THEN 'General' END
  WHEN p = 'gelbooru' THEN CASE c WHEN 'general' THEN 'General' END
  WHEN p = 'sankaku' THEN CASE c WHEN 's' THEN 'Safe' WHEN 'q' THEN 'Questionable' END END AS label FROM x""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", bands.provider_rating_label(F.expr(PROVIDER), F.expr(CODE)).alias("label"))
