"""Fingerprints, graphs, languages, pages, packing and token counts against brute force, and odd rows."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from vitrine.llm import graph_index, language, main_text, near_copies, packing, q_texts, token_counts
from vitrine.operators import scale

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " \n", "7", "Ä", "word " * 3000, "a<|endoftext|>b", "\x00  x", "漢字 🙂", "same", "same"]


def groups_by_hand(marks, ids, distance):
    """Smallest id each row reaches by links between all pairs."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(marks)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(marks))]


@pytest.mark.parametrize("limit", [200, 5000, 1 << 20])
def test_ball_labels_link_all_near_fingerprints(limit):
    r = random.Random(limit)
    seeds = [r.getrandbits(64) for _ in range(12)]
    marks = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(6)})
    labels = near_copies.ball_labels(np.array(marks, dtype=np.uint64), np.full(len(marks), 2), 0, 4, limit)
    want = groups_by_hand(marks, list(range(len(marks))), 4)
    assert labels.tolist() == want


def test_near_copies_equal_all_pairs(spark):
    r = random.Random(8)
    base = [[f"w{r.randint(0, 400)}" for _ in range(200)] for _ in range(5)]
    texts = list(ODD)
    for words in base:
        for _ in range(8):
            copy = list(words)
            copy[r.randrange(200)] = "changed"
            texts.append(" ".join(copy))
    rows = [(100 - i, t, "f") for i, t in enumerate(texts)] + [(None, texts[-1], "f")]
    df = spark.createDataFrame(rows, "item_id long, caption string, fingerprint string").repartition(3)
    got = near_copies.near_copies(df, keep=["item_id", "caption"]).collect()
    marks = [near_copies.simhash(t.encode() if t is not None else None) for _, t, _ in rows]
    want = dict(zip([i for i, *_ in rows], groups_by_hand(marks, [i or 10**9 for i, *_ in rows], 4), strict=True))
    assert len(got) == len(rows)
    assert {g.item_id: g.component_id for g in got} == want
    assert {g.item_id: int(g.fingerprint, 16) for g in got} == dict(zip([i for i, *_ in rows], marks, strict=True))
    assert len(set(want.values())) == sum(g.representative for g in got)
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_simhash_by_the_definition():
    import xxhash

    text = "The quick brown fox JUMPS over the lazy dog É again and again and again"
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert near_copies.simhash(text.encode()) == want


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 5000), (5000, 5000)], "a long, b long")
    got = {r.node: r.root for r in near_copies.connected(links).collect()}
    assert {got[i] for i in range(201)} == {0} and got[5000] == got[1000] == 1000
    assert near_copies.connected(links.limit(0)).count() == 0


def test_graph_search_finds_nearly_all(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 16))
    v[700:760] = v[5]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None], 1), (None, v[0].tolist(), 1), (3, v[3].tolist(), 1)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [2.0, 2.0], 1), (3002, [], 1)]
    points = spark.createDataFrame(rows, "item_id long, vec array<double>, rank int")
    asked = points.where("item_id % 50 = 0 OR item_id = 5 OR item_id >= 2000")
    got = graph_index.near_items(points, asked, k=10, shard_rows=400).toPandas()
    hits = total = 0
    for q in [*range(0, 1500, 50), 5]:
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and q not in set(mine.item_id)
        np.testing.assert_allclose(mine.distance, d[mine.item_id], rtol=1e-12)
        hits, total = hits + len(set(want) & set(mine.item_id)), total + 10
    assert hits / total > 0.97
    assert got[got.query_id == 5].item_id.tolist() == list(range(700, 710))
    assert got[got.query_id == 3000].item_id.tolist() == [3001]
    assert set(got.query_id) & {2000, 2001, 2002, 2003, 3002} == set()
    assert graph_index.near_items(points.limit(0), points.limit(0)).count() == 0


def test_recall_of_the_query(spark):
    got = q_texts.R.queries["op1_near_items"](spark, SMALL).toPandas()
    e = pd.read_parquet(f"{SMALL}/embeddings.parquet").sort_values("vec_id")
    v, ids = np.vstack(e.embedding).astype(float), e.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got[got.query_id == q].vec_id))
        total += 10
    assert hits / total >= 0.9


def test_language_of_held_out_texts(spark):
    got = q_texts.R.queries["op5_detect_language"](spark, SMALL.replace("0.001", "0.01")).toPandas()
    docs = pd.read_parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    both = docs.merge(got, on="doc_id")
    assert len(both) == len(docs) and (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    assert (both[both.held_out].lang == both[both.held_out].lang_pred).mean() > 0.98
    assert both.score.between(0, 1).all()


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    assert code.shape[0] == n and (abs(code.sum(axis=0)) < n).all()
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, code.shape[1] // 5)


def test_language_odd_rows(spark):
    labelled = spark.createDataFrame([("the house and the tree", "en"), ("das Haus und der Baum", "de"), (None, "xx"), ("x", None)], "caption string, lang string")
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(ODD)], "item_id long, caption string, score double")
    found = {r.item_id: r for r in language.detect_language(df, language.fit_languages(labelled)).collect()}
    assert [found[i].lang_pred == "und" for i in range(5)] == [True, True, True, True, False]
    assert found[0].score == 0 and found[0].ambiguous and {found[i].lang_pred for i in range(5, 11)} <= {"en", "de"}
    none = language.fit_languages(labelled.limit(0))
    assert {r.lang_pred for r in language.detect_language(df, none).collect()} == {"und"}
    one = language.fit_languages(labelled.where("lang = 'en'"))
    assert {r.lang_pred for r in language.detect_language(df, one).collect()} == {"und", "en"}
    assert language.detect_language(df.limit(0), one).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<div id="top-menu"><a href=/>Home</a> <a href=/a>News</a></div><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<article><header><h1>A &amp; B</h1></header><p>First  paragraph of <b>bold</b>ness&nbsp;here, with <a href="x">a link</a> in it.
<script>if (a < b) document.write("<p>no</p>")</script><!-- <p>hidden</p> --><aside>See also this other story.</aside>
<p>Second one, 1 &lt; 2.<br>After a break.<form><input name=q> Search</form><div class="advert">Buy now, very cheap.</div></article>
<div class="sidebar"><p>Popular stories you may like.</p></div><section id="comments"><p>Nice article, I liked it a lot!</p></section>
<footer>&copy; someone</footer></body></html>"""
ARTICLE = "A & B\nFirst paragraph of boldness here, with a link in it.\nSecond one, 1 < 2.\nAfter a break."


def test_main_text_of_a_page():
    weights = main_text.weights_of(main_text_counts([PAGE]))
    assert main_text.extract(PAGE, weights) == ARTICLE
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    # without an article around it, the header is the page's
    assert main_text.extract(bare, weights) == ARTICLE.split("\n", 1)[1]


def main_text_counts(pages):
    sums = {}
    for p in pages:
        for k, (a, b) in main_text.token_counts(p).items():
            x = sums.get(k, (0, 0))
            sums[k] = (x[0] + a, x[1] + b)
    return sums


def test_best_run_equals_all_runs():
    r = random.Random(2)
    for _ in range(200):
        s = [r.choice([-2.5, -1.0, 0.5, 1.0, 3.0]) for _ in range(r.randint(0, 12))]
        first, last = main_text.best_run(s)
        runs = [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        assert sum(s[first : last + 1]) == pytest.approx(max([0.0, *runs]))


def test_main_text_odd_rows(spark):
    pages = [None, "", "plain words only", "<p>open <b>never closed", "<div class=ad>x", "< <<>> 1 < 2", "<p>a" * 20000, PAGE, PAGE, "</p></div></article>", "<nav>menu <article>left open"]
    df = spark.createDataFrame([(i, "u", p, "old") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in main_text.main_text(df, main_text.fit_weights(df)).collect()}
    assert [got[i].text for i in (0, 1, 2, 3, 4, 9)] == ["", "", "plain words only", "open never closed", "", ""]
    assert got[6].text == "\n".join("a" * 20000) and got[7].text == got[8].text == ARTICLE and got[10].text == "left open"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert main_text.main_text(df.limit(0), main_text.fit_weights(df.limit(0))).count() == 0


def test_query_finds_the_articles(spark):
    got = q_texts.R.queries["op2_main_text"](spark, SMALL).toPandas().set_index("page_id")
    for page, html in pd.read_parquet(f"{SMALL}/pages.parquet")[["page_id", "html"]].itertuples(index=False):
        inside = html.split("<article>")[1].split("</article>")[0]
        assert got.text[page].count("\n") <= inside.count("<")
        first = inside.split("<p>")[-1].split("<")[0].split()
        assert " ".join(first).replace("&amp;", "&") in got.text[page]


def check_pieces(pieces, texts, window):
    tok = Tokenizer.from_file(BPE)
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, t in texts.items()}
    for i, rows in pieces.groupby("item_id"):
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.length > 0 and r.token_ids == ids[i][at : at + r.length].tobytes() and r.caption_tokens == len(ids[i])
            at += r.length
        assert at == len(ids[i])
    assert set(pieces.item_id) == set(ids)
    for _, rows in pieces.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        ends = (rows.offset + rows.length).tolist()
        assert rows.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= window
        assert ends[-1] & (ends[-1] - 1) == 0


def test_packing_round_trip(spark):
    r = random.Random(6)
    texts = dict(enumerate([*ODD, *[" ".join(r.choice(["red", "blue", "sky", "tree"]) for _ in range(r.randint(1, 90))) for _ in range(60)]]))
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "item_id long, caption string, start int")
    pieces = packing.pack_captions(df, BPE, window=64, shard_tokens=1500).toPandas()
    assert pieces.sequence_id.floordiv(packing.SEQUENCE).nunique() > 2
    check_pieces(pieces, texts, 64)
    assert packing.pack_captions(df.limit(0), BPE).count() == 0
    same = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "item_id long, caption string")
    assert packing.pack_captions(same, BPE).agg(F.sum("length")).first()[0] == 9


def test_seed_windows_hold_the_best_neighbours():
    """BM25 by its formula, term by term; the seed is followed by the caption that scores best."""
    rng = np.random.default_rng(1)
    ids = [np.unique(rng.integers(0, 400, size=rng.integers(5, 30))).astype(np.uint16) for _ in range(80)]
    frequencies = np.bincount(np.concatenate(ids), minlength=400).astype(float)
    n, mean = len(ids), float(np.mean([len(i) for i in ids]))
    index = packing.Bm25Shard(ids, frequencies, n, mean)
    for seed in range(n):
        want = np.zeros(n)
        for t in ids[seed]:
            if frequencies[t] <= packing.COMMON * n:
                idf = np.log(1 + (n - frequencies[t] + 0.5) / (frequencies[t] + 0.5))
                for d in range(n):
                    tf = (ids[d] == t).sum()
                    want[d] += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids[d]) / mean))
        np.testing.assert_allclose(index.scores(seed), want, atol=1e-9)
    pieces = packing.pack_shard(ids, index, 64)
    first = [p for p in pieces if p[3] == 0]
    scores = index.scores(0)
    scores[0] = -1
    assert first[0][0] == 0 and first[1][0] == int(scores.argmax())


def test_encoder_equals_the_tokenizer():
    tok, enc = Tokenizer.from_file(BPE), packing.encoder(BPE)
    r = random.Random(9)
    texts = [t for t in ODD if t] + ["".join(r.choice("ab 'sé漢\n\t<|>0²🙂") for _ in range(r.randint(1, 30))) for _ in range(300)]
    for t in texts:
        assert packing.encode(enc, t).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0]


def unigram_tokenizer():
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = lambda i: not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))
    vocab = [(f"\x00{i}" if m.is_control(i) else m.id_to_piece(i), m.get_score(i) if plain(i) else 0.0) for i in range(m.vocab_size())]
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return tok


def test_token_counts_equal_the_tokenizer(spark):
    tok, r = unigram_tokenizer(), random.Random(7)
    texts = [*ODD, *["".join(r.choice("abeth  \n▁é漢🙂.\tß") for _ in range(r.randint(0, 25))) for _ in range(400)]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "item_id long, caption string, n_tokens int")
    got = {x.item_id: x.n_tokens for x in token_counts.count_tokens(df, PIECES).collect()}
    assert got == {i: len(tok.encode(t or "").ids) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(df.limit(0), PIECES).count() == 0


def test_counts_with_ties_and_fractions_equal_the_tokenizer():
    """Scores with many ties, and some that are no whole numbers, where texts are not cut into words."""
    r = random.Random(1)
    vocab = [("<unk>", 0.0), *[(p, r.choice([-1.0, -2.0, -2.5])) for p in ("▁", "a", "b", "ab", "ba", "aa", "▁a", "aba", "abab", "b▁a")]]
    for fallback in (False, True):
        tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
        tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
        own = token_counts.UnigramCounter(vocab[1:], False)
        for _ in range(300):
            t = "".join(r.choice("aabb cé"[: 7 if fallback else 5]) for _ in range(r.randint(0, 20)))
            assert own.count(t) == len(tok.encode(t).ids), t


def test_stars_take_no_round(spark, monkeypatch):
    """Links that are stars already are stored once; others go on until they are."""
    kept = []
    monkeypatch.setattr(near_copies, "stored", lambda df: kept.append(1) or scale.stored(df))
    stars = [(i, 0) for i in range(1, 50)] + [(i, 100) for i in range(101, 120)]
    got = {r.node: r.root for r in near_copies.connected(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {a: b for a, b in stars} | {0: 0, 100: 100} and len(kept) == 1
    two = near_copies.connected(spark.createDataFrame([*stars, (119, 3)], "a long, b long"))
    assert {r.root for r in two.collect()} == {0} and two.count() == 70 and len(kept) > 2
