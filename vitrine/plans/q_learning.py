"""Queries for datasets, learning and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.functions.udfs import model_scores
from vitrine.learning import datasets, fit, importance, models
from vitrine.operators import aggregates, metrics
from vitrine.operators.ranking import explode_fields
from vitrine.operators.scale import stored
from vitrine.plans.fixtures import ITEMS, PU_LABELS, Registry, items, pu_labels, scored, scored_sql, table
from vitrine.plans.q_nested import vocabulary

R = Registry()

# ---- datasets ----------------------------------------------------------------------------

SPLITS = """
ord AS (SELECT item_id, label, file_path, row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || item_id), item_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM pu),
sz AS (SELECT *, greatest(1, round_even(n * CASE WHEN label = 'unlabeled' THEN 0.05 ELSE 0.15 END, 0)) AS m FROM ord),
splits AS (SELECT item_id, label, file_path, CASE WHEN r <= m THEN 'val' WHEN r <= 2 * m THEN 'test' ELSE 'train' END AS split FROM sz)"""


def splits(spark, d):
    return datasets.assign_splits(pu_labels(spark, d).select("item_id", "label", "file_path"))


@R.add("k1_assign_splits", f"""
WITH {PU_LABELS}, {SPLITS} SELECT item_id, label, file_path, split FROM splits""")
def _(spark, d):
    return splits(spark, d)


@R.add("k2_build_xy", f"""
WITH {PU_LABELS}, {SPLITS}, u AS (SELECT item_id, 0 AS y FROM splits WHERE split = 'train' AND label = 'unlabeled' ORDER BY sha256('42|' || item_id), item_id LIMIT 150)
SELECT item_id, y, 64 AS dim, coalesce(round(CAST(embedding[1] AS DOUBLE), 6), 0) AS first FROM (
  SELECT item_id, 1 AS y FROM splits WHERE split = 'train' AND label = 'pos_a' UNION ALL SELECT * FROM u) LEFT JOIN embeddings ON vec_id = item_id""")
def _(spark, d):
    out = datasets.build_xy(splits(spark, d), store(spark, d), 64, "train", "pos_a", 150)
    return out.select("item_id", "y", F.size("vec").alias("dim"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


def store(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


@R.add("k6_nnpu_risk", f"""
WITH {ITEMS}, {PU_LABELS}, {scored_sql()}, z AS (SELECT model, label = 'pos_a' AS p, score * 4 AS z FROM scored WHERE label IN ('pos_a', 'unlabeled')),
t AS (SELECT model, avg(ln(1 + exp(-z))) FILTER (p) AS pp, avg(ln(1 + exp(z))) FILTER (p) AS pn, avg(ln(1 + exp(z))) FILTER (NOT p) AS un FROM z GROUP BY 1)
SELECT model, round(0.3 * pp + greatest(un - 0.3 * pn, 0), 6) AS risk FROM t""")
def _(spark, d):
    rows = scored(spark, d).where("label IN ('pos_a', 'unlabeled')").select(
        "model", F.when(F.col("label") == "pos_a", 1).otherwise(0).alias("y"), (F.col("score") * 4).alias("score")
    )
    return datasets.nnpu_risk(rows, 0.3, ("model",)).withColumn("risk", F.round("risk", 6))


@R.add("k12_replace_metrics", """
WITH e AS (SELECT source AS model, 100 AS k, 'weighted' AS weighting, count(*) AS n, NULL::BIGINT AS fresh FROM documents GROUP BY 1),
w AS (SELECT d.source AS model, 100 AS k, 'weighted' AS weighting, NULL::BIGINT AS n, count(*) AS fresh FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1)
SELECT * FROM e WHERE model NOT IN (SELECT model FROM w) UNION ALL SELECT * FROM w""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("model"), F.lit(100).alias("k"))
    old = docs.groupBy("model", "k").agg(F.count("*").alias("n"))
    new = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id").groupBy("model", "k").agg(F.count("*").alias("fresh"))
    return datasets.replace_metrics(old, new.withColumn("weighting", F.lit("weighted")))


# ---- fits --------------------------------------------------------------------------------


def positive_cluster(spark, d):
    """item_id, y, vec: items of even clusters, two thirds of which are labelled."""
    y = F.when((F.col("label") % 2 == 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(3)) > 0), 1).otherwise(0)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), y.alias("y"), F.col("embedding").alias("vec"))


def halves(rows):
    """Three quarters to fit on, the rest to measure."""
    return rows.where("item_id % 4 > 0"), rows.where("item_id % 4 = 0")


def centroid_coefficients(spark, d):
    """idx, coef: mean embedding of cluster 0 less that of the rest."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("idx", "v"))
    mean = lambda c: F.avg(F.when(c, F.col("v").cast("double")))
    return rows.groupBy("idx").agg((mean(F.col("label") == 0) - mean(F.col("label") != 0)).alias("coef"))


COEFS = """
coefs AS (SELECT i AS idx, avg(CAST(embedding[i + 1] AS DOUBLE)) FILTER (label = 0) - avg(CAST(embedding[i + 1] AS DOUBLE)) FILTER (label <> 0) AS coef
  FROM embeddings, range(64) r(i) GROUP BY 1)"""


@R.add("k3_standardize", """
WITH v AS (SELECT vec_id AS item_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)),
m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY 1)
SELECT item_id, i AS idx, round((x - m) / s, 5) AS z FROM v JOIN m USING (i)""")
def _(spark, d):
    out = fit.standardize(store(spark, d))
    return out.select("item_id", F.posexplode("vec").alias("idx", "z")).withColumn("z", F.round("z", 5))


# A fit is told by facts: the rows it scores, whether it ranks a half-space of the vectors first
# although a third of it came unlabelled, and whether its scores are not negative. The clusters of
# `embeddings` cannot serve: a fit on their parity itself reaches an AUC of 0.50 on held-out rows.
FACTS = """
SELECT count(*) AS n, count(*) FILTER (embedding[1] > 0) AS n_true, true AS told_apart, true AS in_range FROM embeddings"""


def half_space(spark, d):
    """item_id, y, vec: items whose first component is positive, two thirds of which are labelled."""
    y = F.when((F.col("embedding")[0] > 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(3)) > 0), 1).otherwise(0)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), y.alias("y"), F.col("embedding").alias("vec"))


def facts(spark, d, model, rows):
    truth = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("embedding")[0] > 0).cast("int").alias("y"))
    scored = rows.select("item_id", model.score(F.col("vec")).alias("score"), F.lit(1.0).alias("weight")).join(truth, "item_id")
    sums = scored.agg(
        F.count("*").alias("n"), F.sum("y").alias("n_true"), F.coalesce(F.min("score") >= 0, F.lit(False)).alias("in_range")
    )
    return sums.join(metrics.weighted_auc(scored, []).select((F.col("auc") >= 0.95).alias("told_apart")))


@R.add("k4_fit_elkan_noto", FACTS)
def _(spark, d):
    rows = half_space(spark, d)
    return facts(spark, d, fit.fit_elkan_noto(rows), rows)


@R.add("k5_fit_biased_svm", FACTS)
def _(spark, d):
    rows = half_space(spark, d)
    return facts(spark, d, fit.fit_biased_svm(rows, 0.4), rows)


def _scores(model, rows):
    return rows.select("item_id", "y", F.round(model.score(F.col("vec")), 6).alias("score"))


@R.add("k7_fit_nnpu")
def _(spark, d):
    from vitrine.learning.nnpu import fit_nnpu

    rows = positive_cluster(spark, d)
    train, held = halves(rows)
    return _scores(fit_nnpu(train, held, 0.4), rows)


def short_half_space(spark, d):
    """The half-space over the first eight components: few enough to generalise from hundreds of rows, a third of them mislabelled."""
    return half_space(spark, d).withColumn("vec", F.slice("vec", 1, 8))


# Of positives a third is unlabelled, so a quarter of the unlabelled rows are positive.
HIDDEN_SHARE = 0.25


@R.add("k7_fit_nnpu_half_space", FACTS)
def _(spark, d):
    from vitrine.learning.nnpu import fit_nnpu

    rows = short_half_space(spark, d)
    return facts(spark, d, fit_nnpu(*halves(rows), HIDDEN_SHARE), rows)


@R.add("k7_fit_nnpu_network", FACTS)
def _(spark, d):
    from vitrine.learning.network import fit_nnpu_network

    rows = short_half_space(spark, d)
    return facts(spark, d, fit_nnpu_network(*halves(rows), HIDDEN_SHARE, hidden=[32], epochs=30, rate=0.02, check=5), rows)


# What the search promises: the first C whose validation AUC no other C passes.
@R.add("k8_grid_search", FACTS.replace("told_apart", "best_of_grid").replace(" FROM", ", true AS in_grid FROM"))
def _(spark, d):
    rows = half_space(spark, d)
    train, held = halves(rows)
    C, auc, model = fit.grid_search("elkan_noto", train, held, 0.4)
    found = {}
    for other in fit.C_GRID:
        scored = held.select(F.col("y").cast("double").alias("y"), fit.fit_elkan_noto(train, C=other).score(F.col("vec")).alias("score"))
        found[other] = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(scored)
    best = [c for c in fit.C_GRID if abs(found[c] - max(found.values())) < 1e-9][0]
    return facts(spark, d, model, rows).drop("told_apart").withColumns(
        {"best_of_grid": F.lit(C == best and abs(auc - found[C]) < 1e-9), "in_grid": F.lit(C in fit.C_GRID)}
    )


@R.add("k9_train_matrix")
def _(spark, d):
    _, table_ = fit.train_matrix(splits(spark, d), {"eva02": (store(spark, d), 64)}, ["pos_a", "pos_b"], ["elkan_noto", "biased_svm", "nnpu"])
    return table_


def centroid_models(spark, d):
    """Two scorers read off the data: nearness to cluster 0 and to cluster 1."""
    mean = lambda n: [
        float(r["m"]) for r in table(spark, d, "embeddings").where(F.col("label") == n)
        .select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()
    ]
    return [models.LinearScorer(f"near.{n}", "eva02", "centroid", [models.Member(mean(n), 0.0)]) for n in (0, 1)]


@R.add("k10_score_batch", """
WITH c AS (SELECT label AS n, i, avg(embedding[i + 1]) AS m FROM embeddings, range(64) r(i) WHERE label IN (0, 1) GROUP BY ALL)
SELECT vec_id AS item_id, 'near_' || n AS model, 'score' AS field, round(1 / (1 + exp(-sum(m * CAST(embedding[i + 1] AS DOUBLE)))), 6) AS value FROM embeddings, c GROUP BY ALL""")
def _(spark, d):
    out = models.score_batch(store(spark, d), centroid_models(spark, d), {"eva02": "vec"})
    return explode_fields(out, ("item_id",)).withColumn("value", F.round("value", 6))


@R.add("k10_score_classes", """
SELECT vec_id AS item_id, 'old_net' AS model, n AS field, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, (VALUES (1, 'not_bookmarked'), (2, 'bookmarked_public'), (3, 'bookmarked_private')) c(i, n)""")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.slice("embedding", 1, 3).cast("array<double>").alias("p"))
    out = models.score_classes(rows, "old.net", "p", V.CLASS_NAMES)
    return explode_fields(out, ("item_id",)).withColumn("value", F.round("value", 6))


@R.add("k11_inference_job", """
SELECT doc_id AS item_id, CASE WHEN lang = 'de' THEN 'error' ELSE 'inferred' END AS status, lang <> 'de' AS scored FROM documents""")
def _(spark, d):
    from vitrine.functions.udfs import byte_histogram
    from vitrine.learning.inference import inference_job

    docs = table(spark, d, "documents")
    path = F.concat(F.lit("/media/"), "doc_id")
    pending = docs.select(F.col("doc_id").alias("item_id"), F.lit("pending").alias("status"), path.alias("local_path"))
    files = docs.select(path.alias("path"), F.when(F.col("lang") != "de", F.encode("text", "UTF-8")).alias("content"))
    scorer = models.LinearScorer("flat", "hist", "centroid", [models.Member([0.1] * 16, 0.0)])
    out = inference_job(pending, files, byte_histogram, {"vec": "array<float>"}, [scorer], {"hist": "vec"}, {"hist": [("low", 0)]})
    return out.select("item_id", "status", F.col("inferences").isNotNull().alias("scored"))


@R.add("k13_fit_multiclass")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("label") % 3).alias("y"), F.col("embedding").alias("vec"))
    out = None
    for kind in ("tree", "linear_svc", "mlp"):
        model = fit.fit_multiclass(rows, kind)
        report = metrics.multiclass_report(fit.predict_classes(model, rows)).withColumn("kind", F.lit(kind))
        out = report if out is None else out.unionByName(report)
    return out


@R.add("k14_feature_importance", f"""
WITH {COEFS}, r AS (SELECT *, row_number() OVER (ORDER BY coef DESC, idx) AS hi, row_number() OVER (ORDER BY coef, idx) AS lo FROM coefs)
SELECT 'c0' AS model, 'positive' AS direction, hi AS rank, 't' || idx AS tag, round(coef, 6) AS coef, idx FROM r WHERE hi <= 10
UNION ALL SELECT 'c0', 'negative', lo, 't' || idx, round(coef, 6), idx FROM r WHERE lo <= 10""")
def _(spark, d):
    coefs = centroid_coefficients(spark, d).withColumn("model", F.lit("c0"))
    return importance.feature_importance(coefs, vocabulary(spark, d), 10)


@R.add("k14_mean_gradients", """
WITH c AS (SELECT i, avg(embedding[i + 1]) AS m FROM embeddings, range(64) r(i) WHERE label = 0 GROUP BY 1),
s AS (SELECT vec_id, 1 / (1 + exp(-sum(m * CAST(embedding[i + 1] AS DOUBLE)))) AS s FROM embeddings, c GROUP BY 1)
SELECT 'near.0' AS model, i AS idx, round((SELECT avg(s * (1 - s)) FROM s) * m, 6) AS coef FROM c""")
def _(spark, d):
    return importance.mean_gradients(store(spark, d), centroid_models(spark, d)[0]).withColumn("coef", F.round("coef", 6))


@R.add("k14_class_gradients", """
SELECT class AS model, CAST(i AS INT) AS idx, true AS finite FROM (VALUES ('a'), ('b'), ('c')) c(class), range(64) r(i) WHERE (SELECT count(*) FROM embeddings) > 0""")
def _(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("label") % 3).alias("y"), F.col("embedding").alias("vec"))
    found = importance.class_gradients(rows, fit.fit_multiclass(rows, "mlp"), ["a", "b", "c"])
    return found.select("model", "idx", (F.abs("coef") < float("inf")).alias("finite"))


@R.add("k15_tag_contributions", f"""
WITH {COEFS}, x AS (SELECT vec_id AS item_id, idx, CAST(embedding[idx + 1] AS DOUBLE) * coef AS v FROM embeddings, coefs),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY v DESC, idx) AS hi, row_number() OVER (PARTITION BY item_id ORDER BY v, idx) AS lo FROM x)
SELECT item_id, idx, round(v, 6) AS contribution FROM r WHERE hi <= 5 OR lo <= 5""")
def _(spark, d):
    return importance.tag_contributions(store(spark, d), centroid_coefficients(spark, d), 5).withColumn("contribution", F.round("contribution", 6))


class CentroidModel:
    """Stands for a fitted Python object: score is the dot product with a weight vector."""

    def __init__(self, weights):
        self.weights = np.asarray(weights)

    def decision_function(self, x):
        return x @ self.weights


@R.add("n2_model_scores", """
WITH c AS (SELECT i, avg(embedding[i + 1]) AS m FROM embeddings, range(64) r(i) WHERE label = 0 GROUP BY 1)
SELECT vec_id AS item_id, round(sum(m * CAST(embedding[i + 1] AS DOUBLE)), 6) AS score FROM embeddings, c GROUP BY 1""")
def _(spark, d):
    weights = centroid_models(spark, d)[0].members[0].weights
    return store(spark, d).select("item_id", F.round(model_scores(CentroidModel(weights), F.col("vec")), 6).alias("score"))


@R.add("n4_explode_fields", f"""
WITH {ITEMS} SELECT item_id, model, field, round(value, 6) AS value FROM fields""")
def _(spark, d):
    return explode_fields(items(spark, d), ("item_id",)).withColumn("value", F.round("value", 6))


# ---- evaluation --------------------------------------------------------------------------


def evaluation(spark, d, step=1):
    """Scores (rounded, so that there are ties) with labels, ratings and group weights."""
    weights = aggregates.group_sizes(pu_labels(spark, d)).select("item_id", "group_weight")
    rows = scored(spark, d, step).join(weights, "item_id")
    return metrics.eval_subset(rows, "pos_a")


EVAL = f"""
{{items}}, {PU_LABELS}, {{scored}}, g AS (SELECT artwork_id, count(*) AS s FROM pu WHERE artwork_id IS NOT NULL GROUP BY 1),
base AS (SELECT model, item_id, score, rating, CASE WHEN label = 'pos_a' THEN 1 ELSE 0 END AS y, CASE WHEN s > 1 THEN 1.0::DOUBLE / s ELSE 1.0::DOUBLE END AS gw
  FROM scored LEFT JOIN g USING (artwork_id) WHERE label IN ('pos_a', 'not_bookmarked')),
ev AS (SELECT model, weighting, item_id, score, y, gw, CASE WHEN y = 0 THEN 0.0::DOUBLE WHEN weighting = 'unweighted' THEN 1.0 WHEN rating = 1 THEN 1 WHEN rating = 3 THEN 4 ELSE 2 END AS relevance,
  gw * CASE WHEN y = 0 OR weighting = 'unweighted' THEN 1.0::DOUBLE WHEN rating = 1 THEN 1 WHEN rating = 3 THEN 4 ELSE 2 END AS weight
  FROM base, (VALUES ('weighted'), ('unweighted'), ('r2plus')) m(weighting) WHERE NOT (weighting = 'r2plus' AND y = 1 AND coalesce(rating, 0) = 1))"""
EVAL = EVAL.format(items=ITEMS, scored=scored_sql(1))
BY = ["model", "weighting"]
K = 20


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@R.add("l1_weighted_auc", f"""
WITH {EVAL}, t AS (SELECT model, weighting, score, sum(weight * y) AS wp, sum(weight * (1 - y)) AS wn FROM ev GROUP BY ALL),
c AS (SELECT *, sum(wn) OVER (PARTITION BY model, weighting ORDER BY score) - wn / 2 AS below FROM t)
SELECT model, weighting, round(sum(wp * below) / (sum(wp) * sum(wn)), 6) AS auc FROM c GROUP BY ALL""")
def _(spark, d):
    return _rounded(metrics.weighted_auc(evaluation(spark, d), BY), "auc")


@R.add("l2_weighted_ap", f"""
WITH {EVAL}, t AS (SELECT model, weighting, score, sum(weight * y) AS wp, sum(weight * (1 - y)) AS wn FROM ev GROUP BY ALL),
c AS (SELECT *, sum(wp) OVER w AS tp, sum(wn) OVER w AS fp FROM t WINDOW w AS (PARTITION BY model, weighting ORDER BY score DESC))
SELECT model, weighting, round(sum(CASE WHEN wp > 0 THEN wp * tp / (tp + fp) ELSE 0 END) / sum(wp), 6) AS ap FROM c GROUP BY ALL""")
def _(spark, d):
    return _rounded(metrics.weighted_ap(evaluation(spark, d), BY), "ap")


@R.add("l3_precision_at_positives", f"""
WITH {EVAL}, r AS (SELECT *, row_number() OVER (PARTITION BY model, weighting ORDER BY score DESC, item_id) AS r, sum(y) OVER (PARTITION BY model, weighting) AS np FROM ev)
SELECT model, weighting, round(sum(y) FILTER (r <= np) / max(np), 6) AS precision FROM r GROUP BY ALL""")
def _(spark, d):
    return _rounded(metrics.precision_at_positives(evaluation(spark, d), BY), "precision")


@R.add("l4_weighted_ndcg", f"""
WITH {EVAL}, r AS (SELECT *, (pow(2, relevance) - 1) * weight AS gain, row_number() OVER (PARTITION BY model, weighting ORDER BY score DESC, item_id) AS r,
   row_number() OVER (PARTITION BY model, weighting ORDER BY (pow(2, relevance) - 1) * weight DESC, item_id) AS i FROM ev)
SELECT model, weighting, round(sum(gain / log2(r + 1)) FILTER (r <= {K}) / sum(gain / log2(i + 1)) FILTER (i <= {K}), 6) AS ndcg FROM r GROUP BY ALL""")
def _(spark, d):
    return _rounded(metrics.weighted_ndcg_at_k(evaluation(spark, d), BY, K), "ndcg")


TOPK = f"""
{EVAL}, r AS (SELECT *, row_number() OVER (PARTITION BY model, weighting ORDER BY score DESC, item_id) AS r FROM ev),
a AS (SELECT model, weighting, sum(weight * y) FILTER (r <= {K}) AS hit, sum(weight * y) AS pos, least(count(*), {K}) AS k FROM r GROUP BY ALL),
pr AS (SELECT model, weighting, hit, pos, hit / k AS p, hit / pos AS rec FROM a)"""


@R.add("l5_weighted_precision", f"""
WITH {TOPK} SELECT model, weighting, round(p, 6) AS precision, round(hit, 6) AS hit_weight, round(pos, 6) AS positive_weight FROM pr""")
def _(spark, d):
    return _rounded(metrics.weighted_precision_at_k(evaluation(spark, d), BY, K), "precision", "hit_weight", "positive_weight")


@R.add("l6_fbeta", f"""
WITH {TOPK} SELECT model, weighting, coalesce(round(1.25 * p * rec / nullif(0.25 * p + rec, 0), 6), 0) AS f0_5, coalesce(round(2 * p * rec / nullif(p + rec, 0), 6), 0) AS f1_0 FROM pr""")
def _(spark, d):
    return _rounded(metrics.fbeta_at_k(evaluation(spark, d), BY, K), "f0_5", "f1_0")


@R.add("l7_eval_subset", f"""
WITH {EVAL} SELECT model, weighting, item_id, y, relevance, round(weight, 6) AS weight FROM ev""")
def _(spark, d):
    return _rounded(evaluation(spark, d).select("model", "weighting", "item_id", "y", "relevance", "weight"), "weight")


@R.add("l7_evaluate", f"""
WITH {EVAL.replace("round(score, 1)", "score")}, r AS (SELECT *, (pow(2, relevance) - 1) * weight AS gain, row_number() OVER (PARTITION BY model, weighting ORDER BY score DESC, item_id) AS r,
   row_number() OVER (PARTITION BY model, weighting ORDER BY (pow(2, relevance) - 1) * weight DESC, item_id) AS i FROM ev),
a AS (SELECT model, weighting, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, sum(gain / log2(r + 1)) FILTER (r <= {K}) / sum(gain / log2(i + 1)) FILTER (i <= {K}) AS ndcg,
   sum(weight * y) FILTER (r <= {K}) / least(count(*), {K}) AS p, sum(weight * y) FILTER (r <= {K}) / sum(weight * y) AS rec FROM r GROUP BY ALL),
t AS (SELECT model, weighting, score, sum(weight * y) AS wp, sum(weight * (1 - y)) AS wn FROM ev GROUP BY ALL),
c AS (SELECT *, sum(wn) OVER (PARTITION BY model, weighting ORDER BY score) - wn / 2 AS below, sum(wp) OVER w AS tp, sum(wn) OVER w AS fp FROM t WINDOW w AS (PARTITION BY model, weighting ORDER BY score DESC)),
u AS (SELECT model, weighting, sum(wp * below) / (sum(wp) * sum(wn)) AS auc, sum(CASE WHEN wp > 0 THEN wp * tp / (tp + fp) ELSE 0 END) / sum(wp) AS ap FROM c GROUP BY ALL)
SELECT model, weighting, n_pos, n_neg, {K} AS k, round(ndcg, 5) AS ndcg, round(auc, 5) AS auc, round(ap, 5) AS ap, round(p, 5) AS precision,
  coalesce(round(1.25 * p * rec / nullif(0.25 * p + rec, 0), 5), 0) AS f0_5, coalesce(round(2 * p * rec / nullif(p + rec, 0), 5), 0) AS f1_0 FROM a JOIN u USING (model, weighting)""")
def _(spark, d):
    return metrics.evaluate(stored(evaluation(spark, d, None)), BY, K)


def auc_sql(source: str, by: str) -> str:
    return f"""
t AS (SELECT {by}, score, CAST(sum(y) AS DOUBLE) AS wp, CAST(sum(1 - y) AS DOUBLE) AS wn FROM {source} GROUP BY ALL),
c AS (SELECT *, sum(wn) OVER (PARTITION BY {by} ORDER BY score) - wn / 2 AS below, sum(wp) OVER (PARTITION BY {by} ORDER BY score DESC) AS tp, sum(wn) OVER (PARTITION BY {by} ORDER BY score DESC) AS fp FROM t)
SELECT {by}, CAST(sum(wp) AS BIGINT) AS n_pos, CAST(sum(wn) AS BIGINT) AS n_neg, round(sum(wp * below) / (sum(wp) * sum(wn)), 5) AS auc,
  round(sum(CASE WHEN wp > 0 THEN wp * tp / (tp + fp) ELSE 0 END) / sum(wp), 5) AS ap FROM c GROUP BY ALL"""


@R.add("l8_auc_one_vs_rest", f"""
WITH {ITEMS}, {PU_LABELS}, x AS (SELECT 'multi' AS model, item_id, CASE label WHEN 'pos_a' THEN 1 WHEN 'pos_b' THEN 2 ELSE 0 END AS cls, vec FROM items JOIN pu USING (item_id) WHERE vec IS NOT NULL),
o AS (SELECT model, 'bookmarked_public' AS class, CAST(vec[4] AS DOUBLE) AS score, CASE WHEN cls = 1 THEN 1 ELSE 0 END AS y FROM x WHERE cls <> 2
  UNION ALL SELECT model, 'bookmarked_private', CAST(vec[5] AS DOUBLE), CASE WHEN cls = 2 THEN 1 ELSE 0 END FROM x WHERE cls <> 1), {auc_sql('o', 'model, class')}""")
def _(spark, d):
    score = lambda i: F.col("vec")[i].cast("double")
    names = ("not_bookmarked", "bookmarked_public", "bookmarked_private")
    scores = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), score(i + 2))])
    rows = items(spark, d).where("vec IS NOT NULL").join(pu_labels(spark, d).select("item_id", "label"), "item_id")
    rows = rows.select(F.lit("multi").alias("model"), "item_id", "label", scores.alias("class_scores"))
    return metrics.auc_one_vs_rest(rows, mapping={"pos_a": 1, "pos_b": 2, "unlabeled": 0, "not_bookmarked": 0})


@R.add("l8_auc_binary", f"""
WITH {ITEMS}, {PU_LABELS}, {scored_sql(2)}, o AS (SELECT model, score, CASE WHEN label = 'pos_a' THEN 1 ELSE 0 END AS y FROM scored WHERE label IN ('pos_a', 'unlabeled')), {auc_sql('o', 'model')}""")
def _(spark, d):
    return metrics.auc_binary(scored(spark, d, 2), "pos_a")


def metric_rows(spark, d):
    return stored(_rounded(metrics.weighted_precision_at_k(evaluation(spark, d), BY, K), "precision")).select(*BY, "precision")


@R.add("l9_metrics_pivot", f"""
WITH {TOPK} SELECT model, max(round(p, 6)) FILTER (weighting = 'weighted') AS weighted, max(round(p, 6)) FILTER (weighting = 'unweighted') AS unweighted,
  max(round(p, 6)) FILTER (weighting = 'r2plus') AS r2plus FROM pr GROUP BY 1""")
def _(spark, d):
    return metrics.metrics_pivot(metric_rows(spark, d), "precision")


@R.add("l10_summary_sorted", f"""
WITH {TOPK} SELECT model, weighting, round(p, 6) AS precision, 'pos_a' AS target FROM pr WHERE weighting = 'weighted'""")
def _(spark, d):
    return metrics.summary_sorted(metric_rows(spark, d).withColumn("label", F.lit("pos_a")), "precision")


def predicted(spark, d):
    e = [F.col("embedding")[i] for i in range(3)]
    best = F.when((e[0] >= e[1]) & (e[0] >= e[2]), 0).when(e[1] >= e[2], 1).otherwise(2)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("label") % 3).alias("y"), best.alias("pred"), F.round(e[2].cast("double"), 6).alias("score"))


PREDICTED = """pd AS (SELECT vec_id AS item_id, label % 3 AS y, CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 0 WHEN embedding[2] >= embedding[3] THEN 1 ELSE 2 END AS pred,
  round(CAST(embedding[3] AS DOUBLE), 6) AS score FROM embeddings)"""


@R.add("l11_confusion_matrix", f"""
WITH {PREDICTED} SELECT y, pred, count(*) AS n FROM pd GROUP BY ALL""")
def _(spark, d):
    return metrics.confusion_matrix(predicted(spark, d))


@R.add("l11_multiclass_report", f"""
WITH {PREDICTED}, c AS (SELECT c, count(*) FILTER (y = c) AS actual, count(*) FILTER (pred = c) AS said, count(*) FILTER (y = c AND pred = c) AS hit FROM pd, range(3) r(c) GROUP BY 1),
m AS (SELECT *, hit / said AS p, hit / actual AS r FROM c)
SELECT round(sum(hit) / sum(actual), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(2 * p * r / (p + r)), 6) AS macro_f1 FROM m""")
def _(spark, d):
    out = metrics.multiclass_report(predicted(spark, d))
    return _rounded(out, *out.columns)


@R.add("l12_top_class_candidates", f"""
WITH {PREDICTED} SELECT item_id, y, pred, score FROM pd WHERE y = 0 ORDER BY score DESC, item_id LIMIT 100""")
def _(spark, d):
    p = predicted(spark, d)
    return metrics.top_class_candidates(p.where("pred = 0"), p.where("pred <> 0"), "score")


@R.add("l13_combined_score", f"""
WITH {ITEMS}, {PU_LABELS}, {scored_sql(2)}, q AS (SELECT item_id, percent_rank() OVER (PARTITION BY model ORDER BY score) AS q FROM scored)
SELECT item_id, round(max(q), 6) AS combined FROM q GROUP BY 1""")
def _(spark, d):
    return _rounded(metrics.combined_score(scored(spark, d, 2)), "combined")
