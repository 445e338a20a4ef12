"""Articles with lists, tables, headings and div paragraphs keep all of them, whatever menus and adverts hold."""

import html as entities
import random
import re
import time

import pytest

from vitrine.llm import main_text

AROUND = """<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><div class="ad">Buy now.</div>{}
<div class="sidebar"><ul><li>Popular</li></ul><table><tr><td>Top</td></tr></table><h2>More</h2></div><footer>(c) someone</footer></body></html>"""
# as in the given pages: articles hold p, b, br and h1 only, lists and div blocks lie in furniture
TRAINING = AROUND.format("<article><h1>A title</h1><p>Some words of an <b>article</b> that go on for a while.<br>And on.</p></article>")
PROSE = "<p>" + "plain words of a paragraph " * 6 + "</p>"
PARTS = {
    "list": "<ul>" + "".join(f"<li>item{i}</li>" for i in range(30)) + "</ul>",
    "table": "<table><tbody>" + "".join(f"<tr><th>row{i}</th><td>cell{i}</td></tr>" for i in range(20)) + "</tbody></table>",
    "headings": "".join(f"<h2>head{i}</h2><h3>sub{i}</h3>" for i in range(10)),
    "div": "".join(f"<div><div>block{i}</div></div>" for i in range(30)),
}


def fitted():
    sums = {}
    for _ in range(200):
        for k, (a, b) in main_text.token_counts(TRAINING).items():
            x = sums.get(k, (0, 0))
            sums[k] = (x[0] + a, x[1] + b)
    return main_text.weights_of(sums)


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("marked", ["article", "div"])
def test_article_keeps_its_blocks(part, marked):
    weights, block = fitted(), PARTS[part]
    for body in (block + PROSE, PROSE + block, PROSE + block + PROSE):
        got = main_text.extract(AROUND.format(f"<{marked}>{body}</{marked}>"), weights)
        want = " ".join(body.replace("<", " <").replace(">", "> ").split("<")[i].split(">")[-1].strip() for i in range(body.count("<") + 1))
        assert got.split() == want.split()


def test_furniture_counts_for_nothing():
    assert not {"li", "ul", "a", "div", "td", "h2", "word link"} & set(main_text.token_counts(TRAINING))


def test_unmarked_text_beside_an_article_stays_out():
    page = AROUND.format(f"<p>Ten words that lie beside the article, not in it.</p><article>{PROSE}</article>")
    assert main_text.extract(page, fitted()).split() == PROSE[3:-4].split()


def plain(html):
    """The article of a given page, by splitting alone."""
    inside = html.split("<article>")[1].split("</article>")[0]
    for tag in ("h1", "p", "/h1", "/p", "br"):
        inside = inside.replace(f"<{tag}>", "\x00")
    blocks = [" ".join(entities.unescape(b.replace("<b>", "").replace("</b>", "")).split()) for b in inside.split("\x00")]
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def given(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return pages, main_text.fit_weights(pages)


def test_query_equals_the_articles_cut_by_hand(spark, given):
    pages, weights = given
    got = main_text.main_text(pages, weights).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.text == plain(r.html) and r.n_chars == len(r.text), r.page_id


def test_weights_do_without_lists(given, monkeypatch):
    """With all lists of furniture emptied, learned weights give the same texts; without learned marks too, the scan alone does."""
    pages, weights = given
    for name in ("FURNITURE", "CUES", "OUTSIDE_ONLY"):
        monkeypatch.setattr(main_text, name, set())
    html = [r.html for r in pages.select("html").collect()]
    sums = {}
    for page in html:
        for k, (a, b) in main_text.token_counts(page).items():
            x = sums.get(k, (0, 0))
            sums[k] = (x[0] + a, x[1] + b)
    learned = main_text.weights_of(sums)
    assert {"mark nav", "mark footer", "mark .ad"} <= {k for k in learned if k.startswith("mark ")} == {k for k in weights if k.startswith("mark ")}
    assert all(main_text.extract(page, learned) == plain(page) for page in html)
    bare = {k: w for k, w in learned.items() if not k.startswith("mark ")}
    assert sum(main_text.extract(page, bare) == plain(page) for page in html) >= 0.98 * len(html)
    monkeypatch.setattr(main_text, "best_run", lambda scores: (0, len(scores) - 1))
    assert not any(main_text.extract(page, bare) == plain(page) for page in html)


def test_class_names_in_no_list_are_learned():
    """Labelled pages show `zq17` beside the content only; a page that marks nothing loses it, in the middle too."""
    labelled = f"<body><div class='zq17'><p>{'Noise of some kind. ' * 5}</p></div><article class='w3'><p>{'Words. ' * 40}</p></article></body>"
    sums = {k: (a * 30, b * 30) for k, (a, b) in main_text.token_counts(labelled).items()}
    one, two = "One sentence of the text that goes on.", "Another sentence of the text that ends it."
    page = f"<body><div class='zq17'>First noise</div><div class='w3'><p>{one}</p><div id=zq17><p>Noise</p></div><p>{two}</p></div><div class='zq17'>Last</div></body>"
    assert main_text.extract(page, main_text.weights_of(sums)) == f"{one}\n{two}"
    few = {k: (a // 30, b // 30) for k, (a, b) in sums.items()}
    assert "Noise" in main_text.extract(page, main_text.weights_of(few))


BROKEN = {
    "tags": "<a ", "names": "<a", "quote": "<div class='x ", "double": '<div class="x ', "declarations": "<!", "ends": "</a ", "comments": "<!-- ",
    "raw": "<script ", "open": "<div>", "furniture": "<nav>", "articles": "<article>", "spaces": "</script  ", "closed": "<a ><b '", "content": "<nav><article>",
}


@pytest.mark.parametrize("part", BROKEN)
@pytest.mark.parametrize("end", ["", "'>", '">', ">"])
def test_broken_pages_take_linear_time(part, end):
    page = BROKEN[part] * (1_000_000 // len(BROKEN[part])) + end + "<p>Last words.</p>"
    begin = time.process_time()
    main_text.extract(page, fitted())
    assert time.process_time() - begin < 10


@pytest.mark.parametrize("seed", range(5))
def test_tag_ends_equal_a_slow_search(seed):
    """Ends found from the table are those of a pattern tried at every place."""
    r = random.Random(seed)
    for _ in range(300):
        page = "".join(r.choices("<>\"' ab/!", k=r.randint(0, 30)))
        slow, ends = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>"), main_text.TagEnds(page)
        ends._look()
        for at in range(len(page) + 1):
            m = slow.match(page, at)
            assert ends.after(at) == (m.end() if m else -1)


def test_unclosed_markup_is_text():
    weights = fitted()
    assert main_text.extract("<p>if a <b and c</p>", weights) == "if a"
    assert main_text.extract("<p>if a <b and c", weights) == "if a <b and c"
    assert main_text.extract("<p>x <a title='>y</p>", weights) == "x <a title='>y"
    assert main_text.extract("<p>one</p><!-- two", weights) == "one"


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "<p>a b</p>", "old", "x"), (1, "<p>a b</p>", "old", "x"), (2, None, None, None)], "page_id long, html string, text string, n_chars string")
    got = main_text.main_text(df, fitted()).select("page_id", "text", "n_chars").collect()
    assert sorted(map(tuple, got)) == [(1, "a b", 3), (1, "a b", 3), (2, "", 0)]
