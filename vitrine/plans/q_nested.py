"""Queries for nested data, text and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import media, text
from vitrine.functions.udfs import byte_histogram, extract_features
from vitrine.operators import joins, near_vectors, nested, vectors
from vitrine.operators.scale import stored
from vitrine.plans.fixtures import ITEMS, Registry, items, table
from vitrine.plans.q_sources import POINTS, entries, points

R = Registry()

# ---- archives and tags -------------------------------------------------------------------


@R.add("i1_media_mapping", """
WITH e AS (SELECT conv_id, conv_id || '-' || turn AS id_str, turn, role, CASE WHEN role = 'user' AND text <> '' THEN text ELSE upper(role) END AS text FROM conversations),
m AS (SELECT *, 1 AS n FROM e UNION ALL SELECT *, 2 FROM e WHERE role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, n ORDER BY lpad(CAST(turn AS VARCHAR), 6, '0') DESC, id_str DESC) AS r FROM m)
SELECT conv_id || '-' || n || '.jpg' AS media_id, id_str, text, CASE WHEN role = 'system' THEN 'bot' ELSE '' END AS screen_name,
       CASE WHEN role = 'system' THEN '7' ELSE role END AS user_id FROM r WHERE r = 1""")
def _(spark, d):
    out = nested.media_mapping(entries(spark, d))
    return out.select("media_id", "id_str", "text", F.col("user.screen_name").alias("screen_name"), F.col("user.id_str").alias("user_id"))


def probabilities(spark, d):
    """(e + 1) / 2 per element: index below 48 is a feature, the rest are characters."""
    probs = F.transform("embedding", lambda x: F.round((x.cast("double") + 1) / 2, 6))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), probs.alias("probs"))


def vocabulary(spark, d):
    """Tags named after the positions of the vectors."""
    longest = table(spark, d, "embeddings").agg(F.max(F.size("embedding")).alias("n"))
    idx = longest.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    kind = F.when(F.col("idx") < 48, "feature").otherwise("character")
    return idx.select("idx", F.concat(F.lit("t"), "idx").alias("tag"), kind.alias("kind"))


def char_ip(spark, d):
    ip = lambda n: F.concat(F.lit("ip"), F.col("idx") % n)
    chars = vocabulary(spark, d).where("kind = 'character'")
    return chars.select("tag", F.explode(F.array_distinct(F.array(ip(3), ip(5)))).alias("ip"))


TAGS = """
p AS (SELECT vec_id AS item_id, i AS idx, 't' || i AS tag, CASE WHEN i < 48 THEN 'feature' ELSE 'character' END AS kind,
        round((CAST(embedding[i + 1] AS DOUBLE) + 1) / 2, 6) AS prob FROM embeddings, range(64) r(i)),
tiers(tier, pos, f, c) AS (VALUES ('high', 1, 0.35, 0.9), ('medium', 2, 0.25, 0.8), ('low', 3, 0.1, 0.5)),
tiered AS (SELECT item_id, tier, pos, kind AS category, tag, prob FROM p, tiers
        WHERE (kind = 'feature' AND prob >= f AND prob >= 0.05) OR (kind = 'character' AND prob >= c AND prob >= 0.2)),
ips AS (SELECT DISTINCT item_id, tier, pos, 'ip' || (CAST(tag[2:] AS INT) % m) AS ip FROM tiered, (VALUES (3), (5)) v(m) WHERE category = 'character')"""


@R.add("i2_tag_probs", f"""
WITH {TAGS} SELECT item_id, idx, tag, kind, prob FROM p WHERE prob >= CASE kind WHEN 'feature' THEN 0.05 ELSE 0.2 END""")
def _(spark, d):
    return nested.tag_probs(probabilities(spark, d), vocabulary(spark, d))


@R.add("i2_tier_tags", f"""
WITH {TAGS} SELECT item_id, tier, category, tag, prob FROM tiered""")
def _(spark, d):
    return nested.tier_tags(probabilities(spark, d), vocabulary(spark, d))


@R.add("i3_derive_ip", f"""
WITH {TAGS} SELECT item_id, tier, array_to_string(list_sort(list(ip)), ',') AS ips FROM ips GROUP BY ALL""")
def _(spark, d):
    tiered = nested.tier_tags(probabilities(spark, d), vocabulary(spark, d))
    return nested.ip_lists(tiered, char_ip(spark, d)).withColumn("ips", F.array_join("ips", ","))


@R.add("i4_ordered_tags", f"""
WITH {TAGS}, a AS (SELECT item_id, tier, pos, category, tag, prob, CASE category WHEN 'character' THEN 1 ELSE 3 END AS cpos FROM tiered
  UNION ALL SELECT item_id, tier, pos, 'ip', ip, NULL, 2 FROM ips),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, tag ORDER BY pos, cpos) AS r FROM a WHERE pos <= 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY cpos, pos, tag) AS position, tag, category, tier, prob FROM k WHERE r = 1""")
def _(spark, d):
    tiered = stored(nested.tier_tags(probabilities(spark, d), vocabulary(spark, d)))
    return nested.ordered_tags(tiered, nested.derive_ip(tiered, char_ip(spark, d)), "medium")


PICKED = [("alpha", 5), ("beta", 0), ("gamma", 63)]


@R.add("i5_important_tag_probs", """
SELECT vec_id AS item_id, round(CAST(embedding[6] AS DOUBLE), 6) AS alpha, round(CAST(embedding[1] AS DOUBLE), 6) AS beta, round(CAST(embedding[64] AS DOUBLE), 6) AS gamma FROM embeddings""")
def _(spark, d):
    m = nested.important_tag_probs(F.col("embedding"), PICKED)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), m.alias("m"))
    return e.select("item_id", *[F.round(F.col("m")[n].cast("double"), 6).alias(n) for n, _ in PICKED])


@R.add("i6_axis_vectors", """
WITH x AS (SELECT vec_id AS item_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v,
   CASE WHEN i >= 48 OR i % 4 = 0 THEN 'character' WHEN i % 4 = 1 THEN 'situation' WHEN i % 4 = 2 THEN 'style' END AS axis FROM embeddings, range(64) r(i))
SELECT item_id, axis, count(*) AS dim, round(sum(v), 6) AS total, round(arg_min(v, i), 6) AS first FROM x WHERE axis IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    names = F.array(*[F.lit(a) for a in ("character", "situation", "style", "other")])
    vocab = vocabulary(spark, d)
    categories = vocab.select("tag", names[F.col("idx") % 4].alias("category"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    wide = nested.axis_vectors(e, nested.axis_indices(vocab, categories))
    long = wide.select("item_id", F.explode(F.create_map(*[x for a in ("character", "situation", "style") for x in (F.lit(a), F.col(a))])).alias("axis", "v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return long.select("item_id", "axis", F.size("v").cast("long").alias("dim"), F.round(total, 6).alias("total"), F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@R.add("i7_group_tags_by_type", """
WITH t AS (SELECT o_custkey, CAST(o_orderpriority[1:1] AS INT) AS code, o_orderpriority AS name FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders))
SELECT o_custkey AS item_id, coalesce(max(name) FILTER (code = 1), '') AS artist, coalesce(max(name) FILTER (code = 3), '') AS copyright,
  coalesce(max(name) FILTER (code = 4), '') AS character, coalesce(max(name) FILTER (code = 5), '') AS general FROM t GROUP BY 1""")
def _(spark, d):
    tag = F.struct(F.substring("o_orderpriority", 1, 1).cast("int").alias("type"), F.col("o_orderpriority").alias("name"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.collect_set(tag).alias("tags"))
    out = nested.group_tags_by_type(o)
    return out.select("item_id", *[F.array_join(F.col(f"{c}.name"), ",").alias(c) for c in ("artist", "copyright", "character", "general")])


@R.add("i8_split_tag_string", """
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1] AS first FROM documents""")
def _(spark, d):
    tags = text.split_tag_string(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tags).alias("n"), F.get(tags, F.lit(0)).alias("first"))


# ---- model outputs -----------------------------------------------------------------------

REPLY = "concat(text, '<think>[[3]]\\n</think>', CASE WHEN turn % 2 = 1 THEN concat('[[', turn % 11, ']] [[5]]') ELSE '' END)"


@R.add("i9_parse_rating", """
SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN turn % 11 END AS rating FROM conversations""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.parse_rating(F.expr(REPLY)).alias("rating"))


@R.add("i10_parse_json_envelope", """
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM events""")
def _(spark, d):
    reply = F.expr("CASE event_type WHEN 'error' THEN 'no object' WHEN 'view' THEN 'bad {\"other\": 1} end' ELSE concat('Sure:\\n', props, '\\ndone') END")
    return table(spark, d, "events").select("event_id", text.parse_json_envelope(reply, "k int", ["k"])["k"].alias("k"))


@R.add("i11_parse_category_json", """
SELECT 'tag' || event_id AS tag, CASE event_type WHEN 'click' THEN 'style' WHEN 'view' THEN 'character' ELSE 'other' END AS category FROM events""")
def _(spark, d):
    answer = F.expr("CASE event_type WHEN 'click' THEN ' Style ' WHEN 'view' THEN 'CHARACTER' ELSE event_type END")
    body = F.concat(F.lit('{"tag'), "event_id", F.lit('": "'), answer, F.lit('"}'))
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("Here you are: "), body, F.lit(" ok"))
    ).when(F.col("event_type") != "click", body).otherwise(body)
    replies = table(spark, d, "events").select(shown.alias("response"))
    vocab = table(spark, d, "events").select(F.concat(F.lit("tag"), "event_id").alias("tag"))
    return text.categorize(vocab, text.parse_category_json(replies))


@R.add("i12_repetition_filter")
def _(spark, d):
    return text.repetition_filter(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@R.add("i13_clean_lines", r"""
WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS line
    FROM (SELECT doc_id, '# title' || chr(10) || replace(text, '. ', chr(10) || chr(10) || '  # x' || chr(10)) || chr(10) AS t FROM documents))),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l WHERE NOT regexp_matches(line, '^\s*#') GROUP BY 1)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(t, '\n{2,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS cleaned FROM j""")
def _(spark, d):
    noisy = F.concat(F.lit("# title\n"), F.replace("text", F.lit(". "), F.lit("\n\n  # x\n")), F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text.clean_lines(noisy), 256).alias("cleaned"))


def png_files(spark, d):
    """A PNG header per document: width is the id, height the length; German ones are broken."""
    head = F.lit("89504E470D0A1A0A0000000D49484452")
    size = lambda c: F.lpad(F.hex(c), 8, "0")
    body = F.concat(F.when(F.col("lang") == "de", F.lit("00")).otherwise(head), size("doc_id"), size("n_chars"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("doc_id").alias("path"), F.unhex(body).alias("content"), "lang",
        F.when(F.col("lang") == "fr", 1).alias("width"), F.lit(None).cast("string").alias("sha256"),
    )


PNG = """png AS (SELECT doc_id, lang, n_chars, unhex((CASE WHEN lang = 'de' THEN '00' ELSE '89504E470D0A1A0A0000000D49484452' END)
  || lpad(hex(doc_id), 8, '0') || lpad(hex(n_chars), 8, '0')) AS b FROM documents)"""


@R.add("i14_content_facts", f"""
WITH {PNG} SELECT doc_id AS item_id, sha256(b) AS sha256, octet_length(b) AS file_size, CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN NULL ELSE doc_id END AS width,
  CASE WHEN lang <> 'de' THEN n_chars END AS height, lang = 'de' AS unreadable FROM png""")
def _(spark, d):
    return media.content_facts(png_files(spark, d)).drop("content", "lang", "path")


@R.add("i15_hash_cache", f"""
WITH {PNG} SELECT doc_id AS path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'known' || doc_id ELSE sha256(b) END AS sha256, doc_id IN (SELECT doc_id FROM labels) AS cached FROM png""")
def _(spark, d):
    files = png_files(spark, d)
    cache = table(spark, d, "labels").select(F.col("doc_id").alias("path"), F.concat(F.lit("known"), "doc_id").alias("sha256"))
    return media.hash_cache(files.select("path"), cache, files)


@R.add("i16_active_flags", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE array_to_string(list_filter([
  CASE WHEN o_orderkey % 3 = 1 THEN 'some' WHEN o_orderkey % 3 = 2 THEN 'much' END, CASE WHEN o_orderpriority = '2-HIGH' THEN 'high' END, CASE WHEN o_totalprice > 200000 THEN 'large' END],
  lambda x: x IS NOT NULL), ',') END AS flags FROM orders""")
def _(spark, d):
    s = F.struct((F.col("o_orderkey") % 3).alias("level"), (F.col("o_orderpriority") == "2-HIGH").alias("high"), (F.col("o_totalprice") > 200000).alias("large"))
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", s).alias("ct"))
    flags = nested.active_flags("ct", ["high", "large"], "level", ("some", "much"))
    return o.select("o_orderkey", F.array_join(flags, ",").alias("flags"))


@R.add("i17_select_variant", """
SELECT event_id, CASE WHEN event_type = 'click' THEN props END AS click, CASE WHEN event_type = 'view' THEN props END AS "view" FROM events""")
def _(spark, d):
    union = F.to_json(F.create_map("event_type", F.from_json("props", "map<string,int>")))
    e = table(spark, d, "events").select("event_id", union.alias("metadata"))
    out = nested.select_variant(nested.select_variant(e, "metadata", "click"), "metadata", "view")
    spaced = lambda c: F.replace(c, F.lit(":"), F.lit(": ")).alias(c)
    return out.select("event_id", spaced("click"), spaced("view"))


# ---- vectors -----------------------------------------------------------------------------


def cosine_sql(axis: str) -> str:
    """Both vectors of every pair on an axis, with the similarity."""
    return f"""
pairs AS (SELECT q.item_id AS query_id, c.item_id, round(list_dot_product(q.v, c.v) / (q.norm * c.norm), 9) AS s
  FROM points q JOIN points c ON q.axis = c.axis AND q.item_id <> c.item_id WHERE q.axis = '{axis}' AND c.status = 'inferred')"""


@R.add("j1_similar_items", f"""
WITH {ITEMS}, {POINTS}, {cosine_sql('eva02')}
SELECT item_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, item_id) AS rank FROM pairs WHERE query_id = 42 ORDER BY s DESC, item_id LIMIT 20""")
def _(spark, d):
    return vectors.similar_items(points(spark, d), 42)


@R.add("j1_similar_items_axis", f"""
WITH {ITEMS}, {POINTS}, r AS (SELECT c.item_id, round(list_dot_product(q.v, c.v) / (q.norm * c.norm), 9) AS s FROM points q JOIN points c ON q.axis = c.axis AND q.item_id <> c.item_id
  WHERE q.axis = 'style' AND q.item_id = 42 AND c.status IN ('inferred', 'pending') AND c.type = 'src7')
SELECT item_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, item_id) AS rank FROM r ORDER BY s DESC, item_id LIMIT 10""")
def _(spark, d):
    return vectors.similar_items(points(spark, d), 42, 10, "style", "inferred, pending", type="src7")


@R.add("e8_attach_documents", f"""
WITH {ITEMS}, {POINTS}, {cosine_sql('eva02')}, b AS (SELECT item_id, s, row_number() OVER (ORDER BY s DESC, item_id) AS rank FROM pairs WHERE query_id = 42)
SELECT item_id, round(s, 6) AS similarity, rank, quality FROM b JOIN labels ON doc_id = item_id WHERE rank <= 20""")
def _(spark, d):
    docs = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    return joins.attach_documents(vectors.similar_items(points(spark, d), 42), docs)


@R.add("j2_similar_items_all", f"""
WITH {ITEMS}, {POINTS}, {cosine_sql('character')}
SELECT * FROM (SELECT query_id, item_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM pairs) WHERE rank <= 5""")
def _(spark, d):
    p = stored(points(spark, d))
    return vectors.similar_items_all(p, p.select("item_id").distinct(), 5, "character")


# What the approximate form promises: exact similarities, and at least nine of ten nearest found.
@R.add("j2_similar_items_near", f"""
WITH {ITEMS}, {POINTS} SELECT count(*) AS asked, true AS exact, true AS found FROM points WHERE axis = 'character'""")
def _(spark, d):
    p = stored(points(spark, d))
    near = stored(near_vectors.similar_items_near(p, p.select("item_id"), 5, "character", run=64))
    truth = stored(vectors.similar_items_all(p, p.select("item_id").distinct(), 5, "character"))
    both = truth.join(near.select("query_id", "item_id", F.col("similarity").alias("_near")), ["query_id", "item_id"])
    asked = near.agg(F.count_distinct("query_id").alias("asked"))
    told = both.agg(F.count("*").alias("_hits"), F.max(F.abs(F.col("similarity") - F.col("_near"))).alias("_off"))
    return asked.join(told).join(truth.agg(F.count("*").alias("_all"))).select(
        "asked", (F.col("_off") < 2e-6).alias("exact"), (F.col("_hits") >= 0.9 * F.col("_all")).alias("found")
    )


@R.add("j3_index_vectors", f"""
WITH {ITEMS} SELECT item_id, date FROM items WHERE status IN ('inferred', 'pending') AND item_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    return vectors.index_vectors(items(spark, d), done, ["inferred", "pending"]).select("item_id", "date")


@R.add("j3_index_vectors_limit", f"""
WITH {ITEMS} SELECT item_id, date FROM items WHERE status = 'inferred' ORDER BY item_id LIMIT 100""")
def _(spark, d):
    return vectors.index_vectors(items(spark, d), items(spark, d), only_missing=False, limit=100).select("item_id", "date")


@R.add("n1_extract_features", f"""
WITH {PNG} SELECT doc_id AS item_id, 16 AS dim, true AS ok FROM png""")
def _(spark, d):
    out = extract_features(png_files(spark, d), byte_histogram, {"vec": "array<float>"})
    return out.select("item_id", F.size("vec").alias("dim"), F.col("error").isNull().alias("ok"))
