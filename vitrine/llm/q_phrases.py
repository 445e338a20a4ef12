"""Queries of the operators that cut, score and count words of texts, with their SQL."""

from __future__ import annotations

from vitrine.llm import byte_network, fill_middle, phrases
from vitrine.llm.q_native import captions
from vitrine.llm.q_texts import held_out
from vitrine.plans.fixtures import Registry, table

R = Registry()


@R.add("op13_mine_phrases", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
w AS (SELECT lang, p, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM q),
v AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase FROM v UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM v WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM v WHERE w3 IS NOT NULL
      UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM v WHERE w4 IS NOT NULL),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 30),
s AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
      FROM (SELECT *, unnest(range(1, size)) AS cut FROM c) c
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : cut], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1 : size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, phrase, max(a) AS held FROM (
        SELECT lang, a, array_to_string(words[i : i + k - 1], ' ') AS phrase
        FROM (SELECT lang, a, words, k, unnest(range(1, size - k + 2)) AS i FROM c, range(2, 4) AS s(k) WHERE k < size)) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN h USING (lang, phrase) WHERE held IS NULL OR 100 * held < 80 * b.a)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= 2000""")
def op13(spark, d):
    return phrases.mine_phrases(captions(spark, d).select("caption", "lang"))


@R.add("op12_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1 : least(a, b)], '') AS prefix,
             array_to_string(units[least(a, b) + 1 : greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1 :], '') AS suffix FROM u)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""")
def op12(spark, d):
    examples = fill_middle.fill_in_middle(captions(spark, d).select("item_id", "caption")).drop("caption")
    return fill_middle.restore_middle(examples).selectExpr(
        "item_id AS doc_id", "n", "form", "prefix_chars", "middle_chars", "fim_sha256 AS output_sha256", "restored_sha256"
    )


@R.add("op11_score_quality")
def op11(spark, d):
    texts = captions(spark, d).select("item_id", "caption")
    labels = table(spark, d, "labels").selectExpr("doc_id AS item_id", "quality")
    network = byte_network.fit_quality(texts.where(~held_out("item_id")), labels.where(~held_out("item_id")))
    return byte_network.score_quality(texts, network).select("item_id", held_out("item_id").alias("held_out"), "score", "predicted").withColumnRenamed("item_id", "doc_id")
