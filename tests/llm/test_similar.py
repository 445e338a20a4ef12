"""Near copies by Jaccard similarity against all pairs."""

import random

import numpy as np
from conftest import SMALL

import corpus_pipeline as P
from vitrine.llm import similar_texts
from vitrine.llm.near_copies import connected


def runs(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def groups_by_hand(texts):
    """Smallest index each text reaches by pairs of Jaccard similarity 0.8 or more."""
    sets, root = [runs(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def planted():
    """Copies that differ in 1 to 9 of 200 words lie on both sides of 0.8; chains, short and blank texts."""
    r = random.Random(5)
    texts = [None, "", "  \n", "a b", "A  b", "a b c", "one two three four five", "ONE two three four five"]
    for _ in range(12):
        words = [f"w{r.randint(0, 4000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for changes in range(1, 10):
            copy = list(words)
            for at in r.sample(range(200), changes):
                copy[at] = f"new{r.random()}"
            texts.append(" ".join(copy))
            if changes < 5:
                words = copy
    return texts


def test_groups_equal_all_pairs(spark):
    texts = planted()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[-1], "x")], "item_id long, caption string, component_id string").repartition(3)
    got = similar_texts.similar_texts(df).collect()
    want = groups_by_hand(texts)
    assert len(got) == len(texts) + 1 and 20 < len(set(want)) < len(texts)
    assert {g.item_id: g.component_id for g in got if g.item_id is not None} == dict(enumerate(want))
    assert sorted(g.item_id for g in got if g.representative) == sorted(set(want))
    assert similar_texts.similar_texts(df.limit(0)).count() == 0


def test_stage_leaves_no_similar_pair(spark):
    """The stage on the smallest table with planted copies, by brute force; copies at 0.8 are more than 4 bits apart."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(300).collect()]
    rows += [(10**6 + i, t) for i, t in enumerate(planted()[8:])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in P.near_dedup(spark, docs, SMALL).collect()}
    rows.sort()
    assert got == {rows[i][0] for i in set(groups_by_hand([t for _, t in rows]))}


def test_rare_pairs_lose_no_similar_pair(spark):
    """Variants around one text, most of them just below 0.8, with edits that many share; sets of unlike sizes; roots of several."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    sets = []
    for i in range(90):
        copy = words[: r.choice([150, 150, 140, 110])]
        for at in r.sample(range(len(copy)), r.randint(0, 7)):
            copy[at] = r.choice(["", "", f"new{i}"])
        sets.append((i, i % 7 if i % 3 else i + 100, sorted({hash(x) % (1 << 40) for x in runs(" ".join(copy))})))
    df = spark.createDataFrame(sets, "_fp long, _root long, _set array<long>")
    got = {(p.a, p.b) for p in similar_texts.rare_pairs(df).collect()}
    for i, root, a in sets:
        for j, other, b in sets[:i]:
            alike = 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})
            assert ((j, i) in got) >= (alike and root != other)
            assert root != other or (j, i) not in got
    assert similar_texts.rare_pairs(df.limit(0)).count() == 0


def test_new_leads_meet_the_other_roots_alone(spark):
    rows = [(1, fp, 100) for fp in range(100, 120)] + [(1, 7, 7), (1, 8, 8), (2, 7, 7), (2, 9, 9)]
    placed = spark.createDataFrame(rows, "_band long, _fp long, _root long")
    leads = set()
    for turn in range(similar_texts.TURNS - 1):
        pairs = {tuple(r) for r in similar_texts._new_leads(placed, turn).collect()}
        # as many pairs as a band has members outside its largest root
        first = {a for a, b in pairs if a >= 100}
        assert len(first) == 1 and {b for a, b in pairs if a in first} == {7, 8} and {p for p in pairs if p[0] < 100} == {(9, 7)}
        leads |= first
    assert len(leads) > 1


def test_further_leads_are_taken_at_once(spark, monkeypatch):
    """Groups that one lead leaves apart are connected again once, however many leads a band takes, and all turns' pairs are in."""
    calls = []
    monkeypatch.setattr(similar_texts, "connected", lambda links: calls.append(1) or connected(links))
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join([*words[:at], f"x{at}", f"y{at}", *words[at + 2 :]]) for at in range(0, 118, 4)] + [f"lone {w}" for w in words[:5]]
    groups = similar_texts.similar_texts(spark.createDataFrame(list(enumerate(texts)), "item_id long, caption string"))
    assert [r.component_id for r in groups.orderBy("item_id").collect()] == groups_by_hand(texts)
    assert len(calls) <= 3
    placed = spark.createDataFrame([(1, fp, 100) for fp in range(100, 120)] + [(1, 7, 7)], "_band long, _fp long, _root long")
    turns = [{tuple(r) for r in similar_texts._new_leads(placed, t).collect()} for t in range(3)]
    assert {tuple(r) for r in similar_texts._new_leads(placed, 0, 1, 2).collect()} == set.union(*turns)


def test_pairs_that_seldom_meet_are_linked(spark):
    """Pairs of similarity 0.8 exactly, of which 25 bands of 5 min-hashes told neither: 8 of 10 runs in common."""
    heads = [
        "w68473 w87714 w38279 w50589 w10311 w37010 w58790 w67249 w86586 w72385 w19762 w99905",
        "w87855 w50717 w67565 w23878 w35913 w32011 w46821 w92596 w5045 w11929 w74547 w16488",
        "w49666 w40353 w91977 w3078 w65764 w76386 w16777 w98954 w87297 w70583 w11891 w99926",
    ]
    texts = [f"{head} {last}" for head in heads for last in ("left", "right")]
    assert groups_by_hand(texts) == [0, 0, 2, 2, 4, 4]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.near_dedup(spark, docs, SMALL).collect()} == {0, 2, 4}


def test_first_marks_meet():
    """Two sets of similarity 0.8 or more share one of their first marks, whichever marks stand last."""
    r = np.random.default_rng(3)
    near = 0
    for turn in range(3000):
        size = int(r.integers(1, 60))
        pool = r.integers(0, 1 << 63, size * 2, dtype=np.uint64)
        a = np.unique(pool[:size])
        b = np.unique(np.r_[a[r.random(len(a)) > 0.1 * r.random()], pool[size : size + int(r.integers(0, 2 + size // 5))]])
        known = np.unique(r.permutation(pool)[: int(r.integers(0, size + 1))])
        common = known, r.permutation(np.arange(1, len(known) + 1)).astype(np.int32)
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            near += 1
            assert np.intersect1d(similar_texts.first_marks(a, common), similar_texts.first_marks(b, common)).size
    assert near > 500


def test_groups_are_the_same_with_and_without_further_leads(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "SPARED", -1)
    texts = planted()[8:60]
    got = similar_texts.similar_texts(spark.createDataFrame(list(enumerate(texts)), "item_id long, caption string"))
    assert [r.component_id for r in got.orderBy("item_id").collect()] == groups_by_hand(texts)
