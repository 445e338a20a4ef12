"""Quality rules, licences, mixing and revisits: their SQL twins, slow versions and odd rows."""

import math
import random
import re

import pytest
from check import compare, duck
from conftest import SMALL
from pyspark.sql import functions as F

from vitrine.llm import licences, mixing, q_native, quality, revisits

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CAPTIONS = "item_id long, caption string, n_words string, _words int, kept string"


@pytest.mark.parametrize("name", list(q_native.R.queries))
def test_query_equals_sql(spark, name):
    problem, rows = compare(spark, duck(SMALL), SMALL, name, q_native.R.queries[name], q_native.R.sql[name])
    assert problem is None and rows > 0, problem


def slow_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
        sum(s in lines[:i] for i, s in enumerate(lines)), len(marked),
    )


def test_caption_counts_equal_a_slow_scan(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b c d e " * 4, "é é é é é\n" * 3, "x" * 5000, "same line\nsame line\n\nsame line "]
    texts += [" ".join(r.choice(["a", "b", "c#", "D|", "\n", "é"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)] * 2, CAPTIONS)
    got = quality.caption_quality(df).collect()
    assert len(got) == 2 * len(texts)
    for row in got:
        want = slow_counts(texts[row.item_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (row.base_failed and row.kept)
    assert quality.caption_quality(df.limit(0)).count() == 0


def test_clean_captions_are_kept_and_junk_goes(spark):
    words = "the small house stands on a hill of green grass and it is seen from far by all who come that way".split()
    clean = " ".join(words)
    junk = [clean.upper(), " ".join(w + "$$$" for w in words), " ".join(f"{w} {w}" for w in words), " | ".join(words)]
    df = spark.createDataFrame(list(enumerate([clean, *junk])), "item_id long, caption string")
    assert [r.item_id for r in quality.caption_quality(df).where("kept").collect()] == [0]


def test_a_filter_on_the_verdict_repeats_no_step(spark):
    df = spark.createDataFrame([(1, "a b")], "item_id long, caption string")
    plan = quality.caption_quality(df).where("kept").select("item_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[\\x20\\x09-\\x0D]+") == 1 and "Python" not in plan


def test_licences_survive_harmless_changes(spark):
    known = licences.known_licences(spark)
    mit = "Copyright (c) 2031 Someone\n\n" + licences.MIT.replace("sublicense", "sub-licence").replace("\n", " ").upper()
    texts = [mit, licences.MIT + " More.", None, "", "!!", "released under the mit licence", licences.BSD_2 + licences.BSD_END]
    df = spark.createDataFrame([(i, t, "d", "l") for i, t in enumerate(texts)] * 2, "item_id long, text string, digest string, licence string")
    got = {r.item_id: (r.licence, r.digest) for r in licences.licence_of(df, known).collect()}
    assert [got[i][0] for i in range(7)] == ["MIT", None, None, None, None, "MIT", "BSD-2-Clause"]
    assert got[2][1] is None and got[3][1] == got[4][1]
    assert licences.licence_of(df.limit(0), known).count() == 0
    assert licences.licence_of(df, known.limit(0)).where("licence IS NOT NULL").count() == 0


def test_mixing_meets_the_targets(spark):
    kind = F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 6 == 0, "b").when(F.col("id") % 9 == 0, None).otherwise("c")
    items = spark.range(6000).select(F.col("id").alias("item_id"), kind.alias("type"), F.lit(9).alias("copy"), F.lit("k").alias("_rate"))
    targets = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 1.0), ("z", 5.0)], "type string, weight double")
    mixed = mixing.mix_types(items, targets, seed=1)
    got = {r.type: r["count"] for r in mixed.groupBy("type").count().collect()}
    assert set(got) == {"a", "b", None}
    for t, share in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        assert abs(got[t] - 6000 * share) < 6 * math.sqrt(6000 * share)
    again = mixing.mix_types(items.repartition(7), targets, seed=1)
    assert sorted(map(tuple, mixed.select("item_id", "copy").collect())) == sorted(map(tuple, again.select("item_id", "copy").collect()))
    keys = [r.shuffle_key for r in mixed.coalesce(1).collect()]
    assert len(set(keys)) == len(keys)


def test_poisson_counts_are_those_of_the_distribution(spark):
    """A high mean is a sum of draws: mean and variance are both the rate."""
    items = spark.range(2000).select(F.col("id").alias("item_id"), F.lit("a").alias("type"))
    targets = spark.createDataFrame([("a", 1.0)], "type string, weight double")
    counts = [r["count"] for r in mixing.mix_types(items, targets, seed=2, total=2000 * 20.0).groupBy("item_id").count().collect()]
    mean = sum(counts) / 2000
    assert abs(mean - 20) < 0.5 and abs(sum((c - mean) ** 2 for c in counts) / 2000 - 20) < 2.5


def test_mixing_odd_rows(spark):
    rows = [(None, None, None), (None, "t", "x"), (1, "t", None), (1, "t", None), (2, "u", "")]
    items = spark.createDataFrame(rows, "item_id long, type string, caption string")
    targets = spark.createDataFrame([("t", 1.0), ("u", 0.0)], "type string, weight double")
    got = mixing.mix_types(items, targets, total=40.0, caption="caption")
    assert {r.type for r in got.collect()} == {"t"}
    assert mixing.mix_types(items.limit(0), targets).count() == 0
    assert mixing.mix_types(items, targets.where("weight < 0")).count() == 0
    sized = mixing.repetition_rates(items.withColumn("n", F.lit(None).cast("long")), targets, size="n").collect()
    assert all(r.rate == 0 for r in sized)


CAPTURES = "item_id long, original_url string, downloaded_at long, status int, headers map<string,string>, outcome int"


def captures(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], CAPTURES)
    return df.withColumn("downloaded_at", F.timestamp_seconds("downloaded_at"))


def test_revisits_refer_to_the_latest_earlier_response(spark):
    tag = lambda t, **h: {"ETag": t, **h}
    rows = [
        (1, "HTTP://A.org:80/x#y", 10, 200, tag('"1"', **{"Content-Type": "text", "Age": "0"})),
        (2, "http://a.org/x", 20, 200, tag('"2"')),
        (3, "http://a.org/x", 15, 304, tag('W/"1"', **{"Content-Type": "other", "Age": "9"})),
        (4, "http://a.org/x", 20, 304, tag('"1"')),
        (5, "http://a.org/x", 30, 304, tag('"1"')),
        (6, "http://a.org/x", 5, 304, tag('"1"')),
        (7, "http://a.org/x", 31, 304, {}),
        (8, "http://a.org/x", 32, 404, None),
        (9, None, 33, 304, tag('"1"')),
        (10, "http://a.org/x", None, 304, tag('"1"')),
        (11, "http://a.org?q", 40, 200, {"Last-Modified": "m"}),
        (12, "http://a.org/?q", 41, 304, {"last-modified": "m "}),
        (13, "http://a.org/x", 50, None, None),
    ]
    got = {r.item_id: r for r in revisits.resolve_revisits(captures(spark, rows)).collect()}
    outcomes = {i: r.outcome for i, r in got.items()}
    assert outcomes == {
        1: "full", 2: "full", 3: "resolved", 4: "resolved", 5: "mismatch", 6: "no_response", 7: "unverified", 8: "other",
        9: "no_response", 10: "no_response", 11: "full", 12: "resolved", 13: "other",
    }
    assert (got[3].refers_to, got[4].refers_to, got[12].refers_to, got[5].refers_to) == (1, 1, 11, None)
    assert got[3].merged_headers == {"etag": 'W/"1"', "content-type": "text", "age": "9"}
    assert revisits.resolve_revisits(captures(spark, rows).limit(0)).count() == 0
    texts = spark.createDataFrame([(1, "one"), (11, "eleven")], "item_id long, content string")
    filled = revisits.with_content(revisits.resolve_revisits(captures(spark, rows)), texts)
    assert {r.item_id: r.content for r in filled.where("content IS NOT NULL").collect()} == {1: "one", 3: "one", 4: "one", 11: "eleven", 12: "eleven"}


def test_revisits_of_one_url_over_many_parts(spark):
    """All rows under one URL: still carried from part to part, each answer to the response before it."""
    r = random.Random(5)
    rows = [(i, "http://a.org/", i * 10, 200 if r.random() < 0.05 else 304, {"ETag": '"t"'}) for i in range(600)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.item_id: r.refers_to for r in revisits.resolve_revisits(captures(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    last = None
    for i, _, _, status, _ in rows:
        assert got[i] == (None if status == 200 else last)
        last = i if status == 200 else last
