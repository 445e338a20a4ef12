import datetime as dt
import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.vectors import linear_maps
from vitrine.functions.udfs import byte_histogram, extract_features
from vitrine.learning import datasets, fit, importance, models
from vitrine.learning.nnpu import fit_nnpu
from vitrine.operators import aggregates, dedup, metrics, nested, ranking, scale, vectors
from vitrine.sources import landing, sinks


def scored(spark, rows):
    return spark.createDataFrame([("m", i, *r) for i, r in enumerate(rows)], "model string, item_id int, y int, score double, weight double, relevance double")


def value(df, column):
    return df.first()[column]


def test_auc_and_ap_share_ties(spark):
    df = scored(spark, [(1, 0.9, 1.0, 0.0), (1, 0.5, 2.0, 0.0), (0, 0.5, 1.0, 0.0), (0, 0.1, 1.0, 0.0)])
    row = metrics.auc_and_ap(df, ["model"]).first()
    assert row["auc"] == pytest.approx(5 / 6) and row["ap"] == pytest.approx(5 / 6)


def test_auc_against_pairs_and_its_mirror(spark):
    random.seed(3)
    rows = [(random.randint(0, 1), round(random.random(), 1), random.choice([0.25, 1.0, 4.0]), 0.0) for _ in range(300)]
    pairs = [(p[2] * n[2], (p[1] > n[1]) + (p[1] == n[1]) / 2) for p in rows if p[0] for n in rows if not n[0]]
    want = sum(w * s for w, s in pairs) / sum(w for w, _ in pairs)
    df = scored(spark, rows)
    assert value(metrics.weighted_auc(df, ["model"]), "auc") == pytest.approx(want)
    assert value(metrics.weighted_auc(df.withColumn("score", -F.col("score")), ["model"]), "auc") == pytest.approx(1 - want)


def test_ndcg_of_the_ideal_order_is_one(spark):
    rel, w = [4.0, 2.0, 1.0, 0.0], [1.0, 0.5, 1.0, 1.0]
    best = [(int(r > 0), 1 - i / 10, x, r) for i, (r, x) in enumerate(zip(rel, w))]
    assert value(metrics.weighted_ndcg_at_k(scored(spark, best), ["model"], 4), "ndcg") == pytest.approx(1.0)
    worst = [(y, -s, x, r) for y, s, x, r in best]
    assert value(metrics.weighted_ndcg_at_k(scored(spark, worst), ["model"], 4), "ndcg") < 1
    none = [(0, s, x, 0.0) for _, s, x, _ in best]
    assert value(metrics.weighted_ndcg_at_k(scored(spark, none), ["model"], 4), "ndcg") == 0


def test_precision_and_fbeta(spark):
    df = scored(spark, [(1, 0.9, 4.0, 0.0), (0, 0.8, 1.0, 0.0), (1, 0.1, 1.0, 0.0)])
    assert value(metrics.weighted_precision_at_k(df, ["model"], 2), "precision") == 2.0
    assert value(metrics.weighted_precision_at_k(df, ["model"], 10), "precision") == pytest.approx(5 / 3)
    assert value(metrics.fbeta_at_k(df, ["model"], 2, (1.0,)), "f1_0") == pytest.approx(2 * 2 * 0.8 / 2.8)
    assert value(metrics.precision_at_positives(df, ["model"]), "precision") == 0.5
    assert value(metrics.precision_at_positives(df.where("y = 0"), ["model"]), "precision") == 0


@pytest.mark.parametrize("n,val,test", [(1, 1, 0), (10, 2, 2), (30, 4, 4)])
def test_split_sizes(spark, n, val, test):
    rows = spark.range(n).select(F.col("id").alias("item_id"), F.lit("twitter").alias("label"))
    got = {r["split"]: r["count"] for r in datasets.assign_splits(rows).groupBy("split").count().collect()}
    assert got.get("val", 0) == val and got.get("test", 0) == test and sum(got.values()) == n


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def duplicates(spark):
    rows = [("b", "h", None, "inferred", "/b"), ("a", "h", at(5), "inferred", "/a"), ("c", "h", at(1), "deduped", None), ("d", "x", at(1), "inferred", "/d"), ("e", None, at(1), "inferred", "/e")]
    return spark.createDataFrame(rows, "key string, sha256 string, downloaded_at timestamp, status string, local_path string")


def test_dedupe_by_hash(spark):
    once = dedup.dedupe_by_hash(duplicates(spark))
    got = {r["key"]: (r["outcome"], r["status"], r["local_path"]) for r in once.collect()}
    assert got == {
        "b": ("canonical", "inferred", "/b"),
        "a": ("deduped", "deduped", None),
        "c": ("already_deduped", "deduped", None),
        "d": ("unique", "inferred", "/d"),
        "e": ("unique", "inferred", "/e"),
    }
    assert [r["freed_path"] for r in once.where("freed_path IS NOT NULL").collect()] == ["/a"]
    again = dedup.dedupe_by_hash(once.drop("outcome", "canonical_key", "freed_path"))
    assert again.where("outcome = 'deduped'").count() == 0
    assert {(r["key"], r["status"]) for r in again.collect()} == {(r["key"], r["status"]) for r in once.collect()}


def test_flag_duplicates_keeps_own_row(spark):
    stored = spark.createDataFrame([("a", "h")], "key string, sha256 string")
    new = spark.createDataFrame([("a", "h", "/a"), ("b", "h", "/b"), ("c", "n", "/c"), ("d", "n", "/d")], "key string, sha256 string, local_path string")
    got = {r["key"]: r["status"] for r in dedup.flag_duplicates(new, stored).collect()}
    assert got == {"a": "pending", "b": "deduped", "c": "pending", "d": "deduped"}


def test_keyset_keeps_ties_and_cursor_loses_them(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.9, 0.5, 0.5, 0.5, 0.1])], "item_id int, value double")
    first = ranking.keyset_page(df, "value", size=2).collect()
    second = ranking.keyset_page(df, "value", (first[-1]["value"], first[-1]["item_id"]), 3).collect()
    assert [r["item_id"] for r in first + second] == [0, 1, 2, 3, 4]
    items = df.select("item_id", F.lit("2024-01-01").alias("date"), F.struct("value").alias("m"))
    assert [r["item_id"] for r in ranking.top_items(items, "2024-01-01", "m.value", 0.5).collect()] == [4]


def test_page_bounds(spark):
    for bad in ({"limit": 0}, {"limit": 201}, {"page": -1}):
        with pytest.raises(ValueError):
            ranking.page_items(spark.range(1), "inferences.m.score", **bad)


def test_tier_bounds_are_inclusive(spark):
    probs = [0.05, 0.1, 0.25, 0.35, 0.2, 0.5, 0.8, 0.9]
    df = spark.createDataFrame([(1, probs)], "item_id int, probs array<double>")
    vocab = spark.createDataFrame([(i, f"t{i}", "feature" if i < 4 else "character") for i in range(8)], "idx int, tag string, kind string")
    tiers = {t: {r["tag"] for r in nested.tier_tags(df, vocab).where(F.col("tier") == t).collect()} for t in ("high", "medium", "low")}
    assert tiers == {"high": {"t3", "t7"}, "medium": {"t2", "t3", "t6", "t7"}, "low": {"t1", "t2", "t3", "t5", "t6", "t7"}}
    assert nested.tag_probs(df, vocab).count() == 8


def test_manual_label_forms(spark):
    df = spark.createDataFrame([('{"a": "pixiv_public", "b": {"label": "pixiv_private", "rating": 3}, "c": {"label": "odd"}, "d": {"label": "not_bookmarked"}}',)], "value string")
    got = {r["path"]: (r["label"], r["rating"]) for r in landing.manual_labels(df).collect()}
    assert got == {"a": ("pixiv_public", None), "b": ("pixiv_private", 3), "d": ("not_bookmarked", None)}


def test_readers(spark, tmp_path):
    (tmp_path / "pages.json").write_text('{"page": 0, "status": 200, "body": "{\\"data\\": [{\\"id\\": 5, \\"file_url\\": \\"http://x/5.png?a\\", \\"created_at\\": {\\"s\\": 7}}]}"}\n{"page": 1, "status": 429, "body": "{}"}\n')
    row = landing.read_posts(spark, str(tmp_path / "pages.json"), "sankaku").first()
    assert (row["post_id"], row["created_at"], row["page"], row["index"]) == (5, "7", 0, 0)
    folder = tmp_path / "media"
    folder.mkdir()
    for name in ("a.JPG", "b.txt", "bare", "c.d.png"):
        (folder / name).write_bytes(b"x")
    assert {r["item_id"] for r in landing.scan_media(spark, str(folder), "p").collect()} == {"p/a", "p/c.d"}
    assert "p/bare" in {r["item_id"] for r in landing.scan_media(spark, str(folder), "p", bare_names=True).collect()}
    (tmp_path / "labels.json").write_text('{"x": "pixiv_public"}')
    assert landing.read_manual_labels(spark, str(tmp_path / "labels.json")).count() == 1
    (tmp_path / "tags.json").write_text('{"hat": 0, "bob": 5}')
    assert landing.read_tag_vocabulary(spark, str(tmp_path / "tags.json"), 3).where("kind = 'character'").first()["tag"] == "bob"


def test_vector_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", "a", "inferred", [3.0, 4.0]), (2, "2024-01-02", "a", "inferred", [0.0, 1.0])], "item_id int, date string, type string, status string, vec array<float>")
    path = str(tmp_path / "points")
    sinks.upsert_vectors(df, {"eva02": "vec"}, path)
    more = df.where("item_id = 1").withColumn("item_id", F.lit(3).cast("int")).unionByName(df.where("item_id = 1").withColumn("status", F.lit("pending")))
    sinks.upsert_vectors(more, {"eva02": "vec"}, path)
    sinks.upsert_vectors(more.where("item_id = 3"), {"eva02": "vec"}, path)
    rows = spark.read.parquet(path).collect()
    assert sorted((r["item_id"], r["status"], r["norm"]) for r in rows) == [(1, "pending", 5.0), (2, "inferred", 1.0), (3, "inferred", 5.0)]


def test_vector_table_loses_and_doubles_nothing(spark, tmp_path):
    """A null date, a point that changes its date (leaving its partition empty), a key twice in a batch."""
    kind = "item_id int, date string, type string, status string, vec array<float>"
    path = str(tmp_path / "points")
    write = lambda rows: sinks.upsert_vectors(spark.createDataFrame(rows, kind), {"eva02": "vec", "style": "vec"}, path)
    write([(1, None, "a", "x", [1.0]), (2, None, "a", "x", [1.0]), (4, "2024-01-01", "a", "x", [1.0])])
    write([(3, None, "a", "x", [1.0])])
    write([(4, "2024-02-02", "a", "y", [1.0]), (4, "2024-02-02", "a", "y", [1.0]), (None, None, "a", "x", [2.0])])
    write([(None, "2024-02-02", "a", "z", [2.0])])
    rows = [(r["item_id"], r["axis"], r["date"] and str(r["date"]), r["status"]) for r in spark.read.parquet(path).collect()]
    want = [(1, None, "x"), (2, None, "x"), (3, None, "x"), (4, "2024-02-02", "y"), (None, "2024-02-02", "z")]
    assert sorted(rows, key=str) == sorted([(i, a, d, s) for i, d, s in want for a in ("eva02", "style")], key=str)


def test_a_broken_store_is_not_overwritten(spark, tmp_path):
    path = tmp_path / "points"
    path.mkdir()
    (path / "part-0.parquet").write_text("no parquet file")
    df = spark.createDataFrame([(1, "2024-01-01", "a", "x", [1.0])], "item_id int, date string, type string, status string, vec array<float>")
    with pytest.raises(Exception, match="(?i)parquet"):
        sinks.upsert_vectors(df, {"eva02": "vec"}, str(path))
    assert (path / "part-0.parquet").read_text() == "no parquet file"


def test_feature_store_grows_once(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "item_id string, vec array<float>")
    sinks.append_features(df.where("item_id = 'a'"), path, "eva02")
    sinks.append_features(df, path, "eva02")
    sinks.append_features(df, path, "eva02")
    sinks.append_features(df, path, "pixai")
    assert sorted(r["item_id"] for r in landing.read_feature_store(spark, path, "eva02").collect()) == ["a", "b"]
    assert spark.read.parquet(path).count() == 4


def test_similar_blocks_equal_one_block(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "eva02", [float(x) for x in rng.normal(size=8)], 1.0, "2024-01-01", "t", "inferred") for i in range(120)]
    rows += [(200 + i, *rows[i][1:]) for i in range(10)]  # exact copies
    points = spark.createDataFrame(rows, "item_id long, axis string, vec array<float>, norm double, date string, type string, status string")
    points = points.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))
    small = vectors.similar_items_all(points, points.select("item_id"), 7, block=16)
    big = vectors.similar_items_all(points, points.select("item_id"), 7, block=1000)
    assert sorted(map(str, small.collect())) == sorted(map(str, big.collect()))
    one = vectors.similar_items(points, 200, 7).select("item_id", "similarity", "rank").collect()
    assert one[0]["item_id"] == 0
    assert sorted(map(str, one)) == sorted(map(str, small.where("query_id = 200").select("item_id", "similarity", "rank").collect()))


def test_linear_maps_with_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 1.0])], "item_id int, vec array<float>").coalesce(1)
    got = {r[0]: r[1] for r in df.select("item_id", linear_maps(F.col("vec"), [[1.0, 1.0], [2.0, 0.0]], [0.0, 5.0])).collect()}
    assert got == {1: [3.0, 7.0], 2: None, 3: [1.0, 5.0]}


def test_similar_to_an_unknown_item(spark):
    points = spark.createDataFrame([(1, "eva02", [1.0], 1.0, "inferred", "d", "t")], "item_id long, axis string, vec array<float>, norm double, status string, date string, type string")
    assert vectors.similar_items(points, 5).columns == ["item_id", "similarity", "rank"]
    assert vectors.similar_items(points, 5).count() == 0


def test_unknown_axis(spark):
    with pytest.raises(ValueError):
        vectors.similar_items(spark.range(1), 1, axis="other")


def clusters(spark, n=400, dim=5, shift=1.5):
    """y marks half of the positives; the other half hides among the unlabeled rows."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        true = int(i % 2 == 0)
        rows.append((i, int(true and i % 4 == 0), true, [float(v) for v in rng.normal(size=dim) + shift * true]))
    return spark.createDataFrame(rows, "item_id long, y int, truth int, vec array<float>")


def hidden_auc(model, rows):
    df = rows.select("item_id", F.col("truth").alias("y"), model.score(F.col("vec")).alias("score"), F.lit(1.0).alias("weight"))
    return metrics.weighted_auc(df, []).first()["auc"]


@pytest.mark.parametrize("method", ["elkan_noto", "biased_svm", "nnpu"])
def test_pu_methods_find_the_hidden_positives(spark, method):
    rows = clusters(spark).persist()
    if method == "elkan_noto":
        model = fit.fit_elkan_noto(rows)
        assert 0 < model.divisor < 1
    elif method == "biased_svm":
        model = fit.fit_biased_svm(rows, 0.4)
        assert len(model.members) == 3
    else:
        model = fit_nnpu(rows, rows, 0.5, epochs=10)
    assert hidden_auc(model, rows) > 0.9


def test_nnpu_risk_fallbacks(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "y int, score double")
    ln2 = float(np.log(2))
    assert datasets.nnpu_risk(df, 0.3).first()["risk"] == pytest.approx(0.3 * ln2 + 0.7 * ln2)
    assert datasets.nnpu_risk(df.where("y = 1"), 0.3).first()["risk"] == pytest.approx(0.3 * ln2)
    assert datasets.nnpu_risk(df.where("y = 0"), 0.3).first()["risk"] == pytest.approx(ln2)
    wild = spark.createDataFrame([(1, -1000.0), (0, 1000.0)], "y int, score double")
    assert datasets.nnpu_risk(wild, 0.5).first()["risk"] == pytest.approx(1500.0)


def test_models_survive_a_table(spark, tmp_path):
    model = models.LinearScorer("a.b", "eva02", "nnpu", [models.Member([1.0, -2.0], 0.5, 2.0, 0.1)], 0.7)
    models.save_models(spark, [model], str(tmp_path / "models"))
    assert models.load_models(spark, str(tmp_path / "models")) == [model]
    df = spark.createDataFrame([(1, [1.0, 1.0])], "item_id int, vec array<float>")
    got = models.score_batch(df, [model], {"eva02": "vec"}).first()["inferences"]["a_b"]["score"]
    assert got == pytest.approx(1 / (1 + np.exp(0.9)) / 0.7)


def test_known_models_are_skipped(spark):
    rows = clusters(spark, 80)
    splits = rows.select("item_id", F.when(F.col("y") == 1, "twitter").otherwise("unlabeled").alias("label"), F.when(F.col("item_id") % 5 == 0, "val").otherwise("train").alias("split"))
    store = rows.select("item_id", "vec")
    fitted, table = fit.train_matrix(splits, {"eva02": (store, 5)}, ["twitter"], ["elkan_noto", "biased_svm"], {"eva02_twitter_biased_svm"})
    assert [m.name for m in fitted] == ["eva02_twitter_elkan_noto"] and table.count() == 1


def test_failing_batch_goes_on(spark):
    content = lambda i: None if i % 4 == 0 else b"" if i == 7 else bytes([i, 255])
    df = spark.createDataFrame([(i, content(i)) for i in range(40)], "item_id int, content binary").coalesce(1)
    out = extract_features(df, byte_histogram, {"vec": "array<float>"}, batch=16)
    assert {r["item_id"] for r in out.where("error IS NOT NULL").collect()} == {7, *range(0, 40, 4)}
    assert out.where("size(vec) = 16").count() == 29


@pytest.mark.parametrize("bound", [0, 200_000])
def test_upsert_keeps_unsupplied_fields(spark, monkeypatch, bound):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", bound)
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "x", None, 1), (2, "y", None, 2), (3, "z", 3, 1)], "k int, s string, n int, o int")
    got = sinks.upsert(old, new, ["k"], [F.col("o")]).select("k", "s", "n").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1), (2, "y", 2), (3, "z", 3)]


def test_twitter_models_are_judged_on_public_labels(spark):
    rows = [(1, "pixiv_public", None), (2, "not_bookmarked", None), (3, "twitter", None), (4, "pixiv_public", 1), (5, "pixiv_public", 3)]
    df = spark.createDataFrame([(*r, None) for r in rows], "item_id int, label string, rating int, group_weight double")
    got = {(r["weighting"], r["item_id"]): (r["y"], r["relevance"], r["weight"]) for r in metrics.eval_subset(df, "twitter").collect()}
    assert len(got) == 4 + 4 + 3 and ("r2plus", 4) not in got
    assert got["weighted", 1] == (1, 2.0, 2.0) and got["weighted", 5] == (1, 4.0, 4.0) and got["unweighted", 5] == (1, 1.0, 1.0)
    assert got["r2plus", 2] == (0, 0.0, 1.0)


def test_exact_median_with_ties(spark):
    random.seed(2)
    rows = [(g, float(random.randint(0, 4))) for g in ("a", "b", "b", "b") for _ in range(random.randint(20, 40))] + [("one", 7.0), ("two", 1.0), ("two", 2.0)]
    got = {r["g"]: (r["n"], r["median"]) for r in aggregates.exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    want = {g: [v for h, v in rows if h == g] for g in {g for g, _ in rows}}
    assert got == {g: (len(v), float(np.median(v))) for g, v in want.items()}


def test_toggle_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, ["c"])], "item_id int, categories array<string>")
    once = dedup.toggle_category(df, F.lit("c"))
    assert {r["item_id"]: (r["categories"], r["isFavorited"]) for r in once.collect()} == {1: (["a", "b", "c"], True), 2: (["c"], True), 3: ([], False)}
    twice = dedup.toggle_category(once, F.lit("c"))
    assert {r["item_id"]: r["categories"] for r in twice.collect()} == {1: ["a", "b"], 2: [], 3: ["c"]}


def test_union_manifest_prefers_private(spark):
    row = lambda *r: spark.createDataFrame(r, "item_id string, artwork_id string, file_path string")
    ids = lambda *r: spark.createDataFrame([(i,) for i in r], "artwork_id string")
    out = dedup.union_manifest(row(("p/1", "1", "/1"), ("p/2", "2", "/2"), ("p/9", "9", "/9")), ids("1"), ids("1", "2"), row(("t/1", None, "/t"), ("t/1", None, "/u")), row(("d/2", "2", "/d2"), ("d/3", "3", "/d3"), ("d/4", None, "/d4")))
    assert {(r["item_id"], r["label"], r["file_path"]) for r in out.collect()} == {("p/1", "pixiv_private", "/1"), ("p/2", "pixiv_public", "/2"), ("t/1", "twitter", "/t"), ("d/3", "unlabeled", "/d3"), ("d/4", "unlabeled", "/d4")}


def test_salted_joins_change_no_result(spark, monkeypatch):
    """The same answers when every key counts as hot, with a third of the rows under one key."""
    n = 900
    hash_ = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 100).cast("string"))
    rows = spark.range(n).select(
        F.col("id").alias("item_id"), F.lpad("id", 5, "0").alias("key"), hash_.alias("sha256"), F.lit("inferred").alias("status"),
        F.timestamp_seconds(F.col("id") * 7919 % 1000).alias("downloaded_at"), F.lit("/x").alias("local_path"), hash_.alias("artwork_id"),
    )
    jobs = {
        "dedupe": lambda: dedup.dedupe_by_hash(rows).select("key", "canonical_key", "outcome", "local_path"),
        "flag": lambda: dedup.flag_duplicates(rows.where("item_id % 2 = 0"), rows.where("item_id % 2 = 1")).select("key", "status"),
        "groups": lambda: aggregates.duplicate_groups(rows).select("key", "n"),
        "sizes": lambda: aggregates.group_sizes(rows).select("item_id", "artwork_group_size"),
        "ranks": lambda: metrics.combined_score(rows.select("item_id", F.lit("m").alias("model"), (F.col("item_id") % 3).cast("double").alias("score"))),
    }
    plain = {name: sorted(map(str, job().collect())) for name, job in jobs.items()}
    salted = functools.partial(scale.skew_join, salts=8, min_hot=1, sample=1)
    for module in (dedup, aggregates, metrics):
        monkeypatch.setattr(module, "skew_join", salted)
    for name, job in jobs.items():
        assert sorted(map(str, job().collect())) == plain[name], name
    pandas = rows.toPandas().sort_values(["downloaded_at", "key"])
    first = pandas.groupby("sha256")["key"].first()
    got = {r["key"]: r["canonical_key"] for r in jobs["dedupe"]().collect()}
    assert all(got[k] == first[h] for k, h in zip(pandas["key"], pandas["sha256"]))


def test_class_gradients_are_mean_finite_differences(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(int(v[0] > 0) + int(v[1] > 0), v.tolist()) for v in x], "y int, vec array<double>")
    model = fit.fit_multiclass(rows, "mlp")
    got = {(r["model"], r["idx"]): r["coef"] for r in importance.class_gradients(rows, model, ["a", "b", "c"]).collect()}
    raw = lambda v: model.predictRaw(Vectors.dense(v)).toArray()
    for i in range(4):
        step = np.eye(4)[i] * 1e-4
        want = np.mean([(raw(v + step) - raw(v - step)) / 2e-4 for v in x], axis=0)
        assert np.allclose([got[c, i] for c in "abc"], want, atol=1e-4)
    linear = fit.fit_multiclass(rows, "linear_svc")
    coefs = importance.class_coefficients(spark, linear, ["a", "b", "c"]).where("model = 'b'").orderBy("idx").collect()
    assert np.allclose([r["coef"] for r in coefs], linear.models[1].coefficients.toArray())


def test_item_ranks_equal_those_of_the_whole_catalogue(spark):
    rows = [(i, "2024-01-01" if i % 3 else "2024-01-02", "inferred" if i % 5 else "error", {"m": {"score": float(i % 4), "x": 1.0}}) for i in range(40)]
    items = spark.createDataFrame(rows, "item_id long, date string, status string, inferences map<string,map<string,double>>")
    every = {(r["item_id"], r["field"]): (r["rank"], r["total"]) for r in ranking.score_ranks(items).collect()}
    for one in (0, 7, 9, 38):
        for r in ranking.item_ranks(items, one).collect():
            assert (r["rank"], r["total"]) == every.get((one, r["field"]), (None, r["total"]))
    assert ranking.item_ranks(items, 99).count() == 0


def test_deep_pages_by_key_hold_whole_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("item_id"), (F.col("id") % 7).alias("value"), F.concat(F.lit("n"), "id").alias("name"))
    order = [F.desc("value"), F.asc("item_id")]
    page = lambda narrow: [tuple(r) for r in scale.top_rows(rows, order, 30, 3000, narrow).collect()]
    want = sorted(((i, i % 7, f"n{i}") for i in range(5000)), key=lambda r: (-r[1], r[0]))[3000:3030]
    assert page(["item_id", "value"]) == want == page(None)
