"""Queries of the operators written with built-in functions only, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import licences, mixing, quality, revisits
from vitrine.plans.fixtures import Registry, table

R = Registry()


def captions(spark, folder: str) -> DataFrame:
    """The given texts as captions of items."""
    d = table(spark, folder, "documents")
    return d.withColumnsRenamed({"doc_id": "item_id", "text": "caption"})


STOPS = ", ".join(sorted({f"'{w}'" for s in quality.STOP_WORDS for w in (s, s.capitalize())}))


def rules_sql(rules) -> str:
    parts = []
    for r in rules:
        amount, over = f"{r.metric} * 100", "1" if r.over == "one" else r.over
        bounds = [f"{amount} >= {over} * {r.least}"] * (r.least is not None) + [f"{amount} <= {over} * {r.most}"] * (r.most is not None)
        parts.append(f"(n_words < {r.after} OR ({' AND '.join(bounds)}))" if r.after > 1 else f"({' AND '.join(bounds)})")
    return " AND ".join(parts)


@R.add("op6_caption_quality", rf"""
WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT row_no, p, array_to_string(words[p : p + 4], ' ') AS gram
      FROM (SELECT row_no, words, unnest(range(1, len(words) - 3)) AS p FROM w)),
twice AS (SELECT row_no, p FROM (SELECT row_no, p, count(*) OVER (PARTITION BY row_no, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT row_no, sum(least(5, coalesce(follows - p, 5))) AS n FROM (
        SELECT row_no, p, lead(p) OVER (PARTITION BY row_no ORDER BY p) AS follows FROM twice) GROUP BY row_no),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, len(list_filter(words, lambda x: x IN ({STOPS}))) AS n_stop_words,
             len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) AS n_echo_words,
             length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN r USING (row_no)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules_sql(quality.RULES)} AS kept FROM b""")
def op6(spark, d):
    judged = quality.caption_quality(captions(spark, d))
    return judged.select(
        judged.item_id.alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def canonical_sql(text: str) -> str:
    lines = f"list_filter(string_split(lower({text}), chr(10)), lambda s: NOT regexp_matches(s, '{licences.HOLDER_LINE}'))"
    out = f"' ' || regexp_replace(array_to_string({lines}, chr(10)), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for old, new in licences.EQUIVALENT.items():
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


KNOWN = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licences.TEXTS)


@R.add("op4_licence_of", f"""
WITH known AS (SELECT digest, min(licence) AS licence FROM (
       SELECT licence, sha256({canonical_sql('text')}) AS digest FROM (VALUES {KNOWN}) AS v(licence, text)) GROUP BY digest),
d AS (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents)
SELECT doc_id, digest, licence FROM d LEFT JOIN known USING (digest)""")
def op4(spark, d):
    found = licences.licence_of(captions(spark, d), licences.known_licences(spark), text="caption")
    return found.select(found.item_id.alias("doc_id"), "digest", "licence")


def items_of(spark, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.withColumnsRenamed({"doc_id": "item_id", "source": "type"})


def even_targets(items: DataFrame) -> DataFrame:
    """Every type the same weight."""
    return items.select("type").distinct().withColumn("weight", F.lit(1.0))


@R.add("op7_mix_types", f"""
WITH held AS (SELECT source, count(*) AS n, (SELECT count(*) FROM documents) / (SELECT count(DISTINCT coalesce('=' || source, '')) FROM documents)::DOUBLE / count(*) AS rate
              FROM documents GROUP BY source),
parts AS (SELECT source, rate, ceil(rate / {mixing.CHUNK})::INT AS draws, rate / ceil(rate / {mixing.CHUNK}) AS mean FROM held),
cdf AS (SELECT source, draws, list(sum_upto ORDER BY k) AS cdf FROM (
          SELECT source, draws, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS sum_upto
          FROM parts, (SELECT unnest(range(0, {mixing.TERMS + 1})) AS k)) GROUP BY source, draws),
u AS (SELECT doc_id, d.source, cdf, j, (('0x' || substr(md5(concat_ws('|', '7', doc_id, j)), 1, 13))::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 52) AS u
      FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source, unnest(range(0, draws)) AS t(j)),
c AS (SELECT doc_id, source, sum(len(list_filter(cdf, lambda x: x < u))) AS copies FROM u GROUP BY doc_id, source)
SELECT doc_id, source, copy::INT AS copy,
       round((('0x' || substr(md5(concat_ws('|', '7s', doc_id, copy)), 1, 13))::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 52), 9) AS shuffle_key
FROM c, unnest(range(0, copies::BIGINT)) AS t(copy)""")
def op7(spark, d):
    items = items_of(spark, d).select("item_id", "type", "text")
    mixed = mixing.mix_types(items, even_targets(items), seed=7, caption="text")
    return mixed.select(mixed.item_id.alias("doc_id"), mixed.type.alias("source"), "copy", F.round("shuffle_key", 9).alias("shuffle_key"))


CANONICAL = """concat(
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1'),
    CASE WHEN rest = '' OR starts_with(rest, '?') THEN '/' ELSE '' END, rest)"""
VALIDATOR = "regexp_replace({0}, '^W/', '')"


def captures(spark, folder: str) -> DataFrame:
    """Three requests of each page: a response, for some pages a changed one, and a not-modified answer under another spelling of the URL."""
    pages = table(spark, folder, "pages").select("page_id", "url", F.md5("html").alias("tag"))
    at = lambda step: F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 50000 + step * 100000)
    header = lambda **h: F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v)])
    tag = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    changed, stale, silent = F.col("page_id") % 7 == 0, F.col("page_id") % 5 == 0, F.col("page_id") % 11 == 0
    new = F.md5(F.concat("tag", F.lit("2")))
    answer_tag = F.when(stale, tag(F.lit("gone"))).otherwise(F.concat(F.lit("W/"), tag(F.when(changed, new).otherwise(F.col("tag")))))
    rows = F.array(
        F.struct(F.lit(0).alias("step"), F.col("url").alias("original_url"), F.lit(200).alias("status"), header(ETag=tag(F.col("tag")), Content_Type=F.lit("text/html"), Age=F.lit("1")).alias("headers")),
        F.struct(F.lit(1).alias("step"), F.col("url").alias("original_url"), F.when(changed, 200).otherwise(404).alias("status"), header(ETag=tag(new), Content_Type=F.lit("text/plain"), Age=F.lit("2")).alias("headers")),
        F.struct(F.lit(2).alias("step"), F.concat(F.col("url"), F.lit("#again")).alias("original_url"), F.lit(304).alias("status"), F.map_filter(header(etag=answer_tag, Content_Type=F.lit("none"), Age=F.lit("3")), lambda k, _: ~silent | (k != "etag")).alias("headers")),
    )
    each = pages.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")
    return each.select((F.col("page_id") * 3 + F.col("step")).alias("item_id"), "original_url", at(F.col("step")).alias("downloaded_at"), "status", "headers")


@R.add("op9_resolve_revisits", f"""
WITH p AS (SELECT page_id, url, md5(html) AS tag, page_id % 50000 AS second FROM pages),
c AS (SELECT page_id * 3 AS item_id, url AS original_url, second AS sec, 200 AS status, '"' || tag || '"' AS etag, 'text/html' AS kind, '1' AS age FROM p
  UNION ALL SELECT page_id * 3 + 1, url, second + 100000, CASE WHEN page_id % 7 = 0 THEN 200 ELSE 404 END, '"' || md5(tag || '2') || '"', 'text/plain', '2' FROM p
  UNION ALL SELECT page_id * 3 + 2, url || '#again', second + 200000, 304,
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"gone"' ELSE 'W/"' || CASE WHEN page_id % 7 = 0 THEN md5(tag || '2') ELSE tag END || '"' END, 'none', '3' FROM p),
b AS (SELECT *, regexp_replace(trim(original_url), '#.*$', '') AS u FROM c),
r AS (SELECT *, substr(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) + 1) AS rest FROM b),
k AS (SELECT item_id, sec, status, etag, kind, age, {CANONICAL} AS canonical_url FROM r),
f AS (SELECT a.*, (SELECT max((o.sec, o.item_id)) FROM k o WHERE o.status = 200 AND o.canonical_url = a.canonical_url AND o.sec < a.sec) AS last FROM k a),
j AS (SELECT f.*, o.item_id AS found, o.etag AS their_tag, o.kind AS their_kind FROM f LEFT JOIN k o ON f.status = 304 AND o.item_id = last[2]),
v AS (SELECT *, CASE WHEN status = 200 THEN 'full' WHEN status <> 304 THEN 'other' WHEN found IS NULL THEN 'no_response'
        WHEN etag IS NULL THEN 'unverified' WHEN {VALIDATOR.format('etag')} = {VALIDATOR.format('their_tag')} THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT item_id, canonical_url, CASE outcome WHEN 'resolved' THEN found END AS refers_to, outcome,
       CASE outcome WHEN 'full' THEN 'age: ' || age || chr(10) || 'content-type: ' || kind || chr(10) || 'etag: ' || etag
            WHEN 'resolved' THEN 'age: ' || age || chr(10) || 'content-type: ' || their_kind || chr(10) || 'etag: ' || etag END AS merged_headers FROM v""")
def op9(spark, d):
    found = revisits.resolve_revisits(captures(spark, d))
    lines = F.transform(F.array_sort(F.map_entries("merged_headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("item_id", "canonical_url", "refers_to", "outcome", F.array_join(lines, "\n").alias("merged_headers"))
