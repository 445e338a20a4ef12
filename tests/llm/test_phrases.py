"""Infilling examples, phrases and the byte network against brute force, and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vitrine.llm import byte_network, fill_middle, phrases, q_phrases

ODD = [None, "", " \n", "7", "Ä", "word " * 3000, "x" * 200_000, "a<P>b", "a<M", "\x00  x", "漢字 🙂 abc", "same", "same"]


# ---- op12


def by_hand(item_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{item_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infilling_equals_cuts_by_hand_and_is_taken_back(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab <>PSM\nÄé漢") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "item_id long, caption string, form string")
    made = fill_middle.restore_middle(fill_middle.fill_in_middle(df))
    found = {r.item_id: r for r in made.collect()}
    assert made.columns == ["item_id", "caption", *fill_middle.ADDED.names, *fill_middle.RESTORED.names]
    for i, text in enumerate(texts):
        r, text = found[i], text or ""
        n, form, prefix, middle, output = by_hand(i, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == (n, form, prefix, middle, output)
        assert r.fim_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored == text and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.form for r in found.values()} == {"plain", "psm", "spm"}


def test_infilling_of_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two")], "item_id long, caption string")
    a, b = fill_middle.restore_middle(fill_middle.fill_in_middle(df)).collect()
    assert a == b and a.restored == "one two"
    assert fill_middle.restore_middle(fill_middle.fill_in_middle(df.limit(0))).count() == 0


def test_piece_table_cuts_without_copying():
    table = fill_middle.PieceTable.of(b"abcdef", b"|")
    table.cut(4), table.cut(4), table.cut(0)
    assert table.text() == b"abcdef" and table.pieces == [(0, 0, 0), (0, 0, 4), (0, 4, 0), (0, 4, 2)]
    turned = table.arrange([(3, 1), (1, None)])
    assert turned.text() == b"|efabcd" and turned.buffers is table.buffers
    assert turned.sha256() == hashlib.sha256(b"|efabcd").hexdigest()


# ---- op13


def phrases_by_hand(rows, least, keep, inside=80):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = []
    for (lang, w), a in counts.items():
        if len(w) == 1 or a < least:
            continue
        held = any(
            v[0] == lang and len(v[1]) > len(w) and f >= least and 100 * f >= inside * a and any(v[1][i : i + len(w)] == w for i in range(len(v[1])))
            for v, f in counts.items()
        )
        if not held:
            cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    out, place = [], Counter()
    for lang, score, a, phrase, l, r in sorted(found):
        place[lang] += 1
        if place[lang] <= keep:
            out.append((lang, place[lang], phrase.decode(), -a, l, r, total[lang], -score))
    return out


@pytest.mark.parametrize("bits,filter_bits", [(62, 1 << 26), (62, 1 << 17), (6, 1 << 17)])
def test_phrases_equal_brute_force_even_if_fingerprints_collide(spark, bits, filter_bits):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "The", "a", "of", "ß", "漢字", "x" * 150, "new", "york", "a\xa0b"])
    rows = [(" ".join(word() + rng.choice(["", "", "", ".", "\n", "\t", "  "]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None])) for _ in range(250)]
    rows += [(None, "en"), ("", "fr"), (" . ", "fr"), ("one two three four five " * 40, "en")] + [("new york", "hot")] * 500
    df = spark.createDataFrame([(t, lang, i) for i, (t, lang) in enumerate(rows)], "caption string, lang string, n long").repartition(3)
    got = phrases.mine_phrases(df, least=12, keep=40, bits=bits, filter_bits=filter_bits)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(phrases_by_hand(rows, 12, 40))


def test_no_captions_no_phrases(spark):
    df = spark.createDataFrame([(None, None), ("a b", "en")], "caption string, lang string")
    assert phrases.mine_phrases(df).count() == 0 and phrases.mine_phrases(df.limit(0)).count() == 0


def test_texts_are_read_twice_and_not_again_for_a_proof(spark):
    read = spark.sparkContext.accumulator(0)

    def tell(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = spark.createDataFrame([("new york is far away", "en")] * 40, "caption string, lang string").repartition(4)
    got = phrases.frequent_phrases(df.mapInPandas(tell, "caption string, lang string"))
    assert got.where("phrase = 'new york is far' AND f = 40").count() == 1 and got.count() == 5 + 4 + 3 + 2 + 1
    assert read.value == 80


@pytest.mark.parametrize("keys", ["own", "one"])
def test_runs_leave_with_their_text_even_if_all_share_a_fingerprint(keys, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 64)
    monkeypatch.setattr(phrases, "TEXT", 256)
    monkeypatch.setattr(phrases, "_tables", {})
    long = "y" * 100
    texts = ["Ab ab abcdefgh abcdefgi", f"{long}a b, {long}c b", f"{long}a b", "漢字 ab ab", None, "", "a" * 8 + " ab"] * 2
    langs = ["en", "a\nb", "a\nb", None, "en", "", ""] * 2
    words = phrases.words_of([t and t.encode() for t in texts], langs)
    for n in (1, 2):
        first, found = phrases.fingerprints(words, n)
        distinct = phrases.proven(words, first, found if keys == "own" else found * 0, n)
        assert distinct[1].sum() == len(first)
        got = Counter()
        for batch in phrases.written(words, *distinct, n):
            for run, c in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                got[tuple(run.split("\n", 1))] += c
        expected = Counter()
        for text, lang in zip(texts, langs, strict=True):
            for piece in (text or "").lower().split(","):
                w = piece.split()
                expected.update((" ".join(w[i : i + n]), "und" if lang is None else lang) for i in range(len(w) - n + 1))
        assert got == expected


def test_languages_may_hold_line_ends(spark):
    df = spark.createDataFrame([("b b", "a\nb"), ("b b", "\na"), ("b b", ""), ("b b", "\n")] * 3, "caption string, lang string")
    got = phrases.mine_phrases(df, least=3).select("lang", "phrase", "a", "l", "r", "n").collect()
    assert sorted(map(tuple, got)) == sorted((lang, "b b", 3, 6, 6, 6) for lang in ("a\nb", "\na", "", "\n"))


def test_prefix_polynomials_do_not_depend_on_blocks(monkeypatch):
    texts = [b"alpha beta gamma " * 50, b"beta gamma, alpha", None, b"gamma alpha beta"]
    whole = phrases.fingerprints(phrases.words_of(texts, ["en"] * 4), 2)[1]
    monkeypatch.setattr(phrases, "BLOCK", 64)
    monkeypatch.setattr(phrases, "_tables", {})
    assert phrases.fingerprints(phrases.words_of(texts, ["en"] * 4), 2)[1].tolist() == whole.tolist()
    assert len(set(whole.tolist())) == 3


# ---- op11


def slow_probability(net, text):
    """The network by its definition: one window after the other."""
    values = list(text) + [byte_network.PAD] * (byte_network.WIDTH - 1) if text else [byte_network.PAD] * byte_network.WIDTH
    n = len(values) - byte_network.WIDTH + 1
    out = []
    for low in range(0, n, byte_network.CHUNK):
        best = np.zeros(byte_network.FILTERS)
        for at in range(low, min(low + byte_network.CHUNK, n)):
            window = np.concatenate([net["codes"][v] for v in values[at : at + byte_network.WIDTH]])
            best = np.maximum(best, window @ net["filters"] + net["floor"])
        out.append(np.maximum(best @ net["mix"] + net["mix_floor"], 0) @ net["last"])
    return 1 / (1 + np.exp(-(np.mean(out) + net["bias"][0])))


def test_network_equals_its_definition_and_its_gradient_finite_differences():
    rng = np.random.default_rng(2)
    theta = byte_network.started(1, 0.7) + rng.normal(0, 0.05, byte_network.SIZE)
    net = byte_network.unpacked(theta)
    for text in (b"", b"a", b"ab" * 128, b"abc" * 300, "Ä漢".encode() * 90):
        assert byte_network.probability(net, text) == pytest.approx(slow_probability(net, text), abs=1e-9)
    text = bytes(rng.integers(97, 105, 700, dtype=np.uint8))
    for label in (0, 1):
        g, _ = byte_network.gradient(theta, text, label)
        for i in rng.choice(np.nonzero(g)[0], 25, replace=False):
            step = np.zeros(byte_network.SIZE)
            step[i] = 1e-6
            slope = (byte_network.gradient(theta + step, text, label)[1] - byte_network.gradient(theta - step, text, label)[1]) / 2e-6
            assert g[i] == pytest.approx(slope, abs=1e-6)


def test_last_bytes_of_a_long_text_count(spark):
    net = byte_network.ByteNetwork(byte_network.started(1, 0.5))
    long = b"a" * (3 * byte_network.PIECE)
    assert net.score(long) != net.score(long[:-200] + b"#" * 200)


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(ODD)], "item_id long, caption string, score double")
    labels = spark.createDataFrame([(3, 1), (7, 0), (7, 0), (0, 1), (None, 1), (99, 0), (4, 5), (5, None)], "item_id long, quality int")
    network = byte_network.fit_quality(df, labels, steps=3)
    assert network.rows == 3
    rows = byte_network.score_quality(df, network).orderBy("item_id").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert rows[0].score == rows[1].score and rows[-1].score == rows[-2].score
    none = byte_network.fit_quality(df, labels.limit(0))
    assert {r.score for r in byte_network.score_quality(df, none).collect()} == {0.5}
    assert byte_network.score_quality(df.limit(0), network).count() == 0


def test_quality_query_tells_held_out_rows(spark):
    found = q_phrases.op11(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    pairs = [(r.score, r.quality) for r in found.collect()]
    good, bad = [s for s, q in pairs if q], [s for s, q in pairs if not q]
    auc = np.mean([g > b for g in good for b in bad])
    assert right >= 0.9 and auc >= 0.95


def test_sql_twins(spark):
    from check import compare, duck

    con = duck(SMALL)
    for name in ("op12_fill_in_middle", "op13_mine_phrases"):
        assert compare(spark, con, SMALL, name, q_phrases.R.queries[name], q_phrases.R.sql[name])[0] is None


def test_frames_unused_columns(spark):
    df = spark.createDataFrame(pd.DataFrame({"item_id": [1], "caption": ["a b c"], "n": [5], "score": [1.0]}))
    assert fill_middle.fill_in_middle(df).first().n == 5
