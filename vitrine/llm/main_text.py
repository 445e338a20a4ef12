"""Main text of web pages: the best scoring run of words and tags, with weights from labelled pages."""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pages the weights are fitted on, about; a bounded sample by a hash of the page id.
FIT_PAGES = 4000
# Weights stay on their side of zero: words above, tags below.
LEAST_WORD, LEAST_TAG, MOST_TAG = 0.05, -0.01, -4.0
# Crossing the edge of an element that marks the content costs as much as this many words.
EDGE = 25.0

# Pages that must show a class, id or role name outside their content, and none inside, before it is held for furniture.
MARK_PAGES = 20

# What opens a comment, a declaration or a tag; a name ends at a quote or "<", so no character is read for two names.
START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>\"'<]*))")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
SPECIAL = re.compile(r"[>\"']")
RAW = {n: re.compile(rf"</{n}\s*+>", re.I) for n in "script style textarea title noscript iframe template svg math".split()}
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = {"article", "main"}
FURNITURE = set("nav aside form footer button select dialog menu head fieldset object audio video canvas".split())
# Parts of class, id and role names of what surrounds an article.
CUES = set(
    "nav navbar navigation menu sidebar aside footer ad ads advert advertisement adverts adsbox sponsor sponsored promo promotion banner"
    " notice notices cookie cookies consent gdpr alert popup modal overlay comment comments disqus reply replies form newsletter subscribe"
    " signup login search share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget".split()
)
# Page headers are furniture, an article's own header is not.
OUTSIDE_ONLY = {"header", "masthead"}
BLOCKS = set(
    "div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center br hr img".split()
)
KNOWN = INLINE | VOID | CONTENT | FURNITURE | OUTSIDE_ONLY | set(
    "html body div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center".split()
)


class Element:
    """An open element: whether it marks furniture, the nearest such element around it, and whether content was found inside."""

    __slots__ = ("holds_content", "in_content", "marks", "name", "outer", "suspect")

    def __init__(self, name: str, suspect: bool, outer: Element | None, in_content: bool, marks: set[str]):
        self.name, self.suspect, self.outer, self.in_content, self.marks = name, suspect, outer, in_content, marks
        self.holds_content = False


class TagEnds:
    """Where tags end, quotes observed. A page that leaves one open is looked through once, from its end, for all of them."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def after(self, at: int) -> int:
        """The end of the tag whose attributes begin at `at`; -1 if there is none."""
        if at > self.last:
            return -1
        if self.places is None:
            if m := INSIDE.match(self.page, at):
                return m.end()
            self._look()
        k = bisect_left(self.places, at)
        return self.ends[k]

    def _look(self) -> None:
        found = [(m.start(), m[0]) for m in SPECIAL.finditer(self.page)]
        self.places, self.ends = [p for p, _ in found], [-1] * (len(found) + 1)
        partner = {"'": -1, '"': -1}
        for k in range(len(found) - 1, -1, -1):
            place, sign = found[k]
            if sign == ">":
                self.ends[k] = place + 1
                continue
            if partner[sign] >= 0:
                self.ends[k] = self.ends[partner[sign] + 1]
            partner[sign] = k


def tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, whether an end tag, attributes) of the markup of a page, in time linear in its length.

    The name is None for comments and declarations. An element of RAW reaches up to its end tag.
    What no ">" closes is text.
    """
    ends, at = TagEnds(page), 0
    while m := START.search(page, at):
        start, name = m.start(), m[2]
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = len(page) if close < 0 else close + 3
            yield start, at, None, False, ""
            continue
        if m.end() > ends.last:
            return
        end = page.index(">", m.end()) + 1 if name is None else ends.after(m.end())
        if end < 0:
            at = m.end()
            continue
        at = end
        if name is None:
            yield start, at, None, False, ""
            continue
        name = name.lower()
        if name in RAW and not m[1]:
            close = RAW[name].search(page, end)
            at = close.end() if close else len(page)
        yield start, at, name, bool(m[1]), page[m.end() : end - 1]


def _facts(name: str, attributes: str) -> tuple[set[str], bool]:
    """The parts of class, id and role names, and whether the element is hidden."""
    parts, hidden = set(), False
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key in ("hidden", "aria-hidden"):
            hidden |= key == "hidden" or value.lower() == "true"
        else:
            parts |= {p.lower() for p in NAME_PART.findall(value)}
    return parts, hidden


def _marks(name: str, parts: set[str]) -> set[str]:
    """What an element may be known by: its class, id and role names, and its own name unless it is a common block."""
    if name in CONTENT or name in ("html", "body"):
        return set()
    own = set() if name in BLOCKS or name in INLINE or name in VOID else {"mark " + name}
    return own | {"mark ." + p for p in parts}


def page_events(page: str | None, learned: dict[str, float] | None = None) -> tuple[list[tuple], list[Element]]:
    """The page as a list of (kind, key, text, furniture, in content, block), and its elements; one scan.

    kind is "tag" or "text"; furniture is whether it lies in an element that `learned` weights or,
    of marks they do not tell about, the lists hold for furniture. One that turns out to hold an
    article is none, which also saves pages that leave a menu open.
    """
    learned = learned or {}
    events, stack, opened, elements = [], [], {}, []
    block = content = links = 0
    at, page = 0, page or ""
    around: Element | None = None

    def text(piece: str) -> None:
        if piece:
            events.append(("text", "link" if links else "plain", piece, around, content > 0, block))

    for start, end, name, closes, attributes in tags(page):
        text(page[at:start])
        at = end
        if name is None or (name in RAW and not closes):
            # comments join what is around them, raw elements do not
            block += name in ("textarea", "iframe")
            continue
        if name not in INLINE:
            block += 1
        key = name if name in KNOWN else "other"
        if closes:
            events.append(("tag", "/" + key, "", around, content > 0, block))  # still with the element that ends
            while opened.get(name):
                e = stack.pop()
                opened[e.name] -= 1
                content -= e.name in CONTENT
                links -= e.name == "a"
                if e.suspect:
                    around = e.outer
                if e.name == name:
                    break
            continue
        parts, hidden = _facts(name, attributes)
        marks = _marks(name, parts)
        outside = OUTSIDE_ONLY if not content else set()
        suspect = name in FURNITURE or name in outside or any(m in learned for m in marks)
        if not suspect and name not in CONTENT and name not in ("html", "body"):
            suspect = hidden or bool(parts & CUES) or bool(parts & outside)
        if name in CONTENT:
            for e in reversed(stack):
                if e.holds_content:
                    break
                e.holds_content = True
        e = Element(name, suspect, around, content > 0, marks)
        within = e if suspect else around
        events.append(("tag", key, "", around, content > 0, block))
        if name not in VOID and not attributes.rstrip().endswith("/"):
            elements.append(e)
            stack.append(e)
            opened[name] = opened.get(name, 0) + 1
            content += name in CONTENT
            links += name == "a"
            around = within
            events[-1] = ("tag", key, "", around, content > 0, block)
    text(page[at:])
    hidden_by: dict[int, bool] = {}
    for e in elements:
        if e.suspect:
            hidden_by[id(e)] = not e.holds_content or (e.outer is not None and hidden_by[id(e.outer)])
    return [(k, key, t, f is not None and hidden_by[id(f)], c, b) for k, key, t, f, c, b in events], elements


def token_counts(page: str | None) -> dict[str, list[int]]:
    """Per token, how many lie inside and outside the content a page marks; none where it marks none.

    Listed furniture says nothing about the words and tags in it. Marks count once a page and side;
    those of an element around the content count as inside.
    """
    events, elements = page_events(page)
    if not any(e[4] for e in events):
        return {}
    counts: dict[str, list[int]] = {}
    for kind, key, piece, furniture, inside, _ in events:
        if (kind == "tag" and key.lstrip("/") in CONTENT) or furniture:
            continue
        found = counts.setdefault("word " + key if kind == "text" else key, [0, 0])
        found[0 if inside else 1] += len(piece.split()) if kind == "text" else 1
    for mark, side in {(m, 0 if e.in_content or e.holds_content else 1) for e in elements for m in e.marks}:
        counts.setdefault(mark, [0, 0])[side] += 1
    return counts


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log of how much likelier a token is inside the content, kept positive for words, negative for tags.

    A block tag that no content holds has shown nothing about content that does hold it, so it
    costs next to nothing. An edge of the content costs EDGE words whatever a word scores. Marks
    that MARK_PAGES pages show outside their content and none inside stand for furniture.
    """
    marks = {m: MOST_TAG for m, (a, b) in counts.items() if m.startswith("mark ") and not a and b >= MARK_PAGES}
    counts = {k: c for k, c in counts.items() if not k.startswith("mark ")}
    inside = sum(c[0] for c in counts.values()) + len(counts) + 1
    outside = sum(c[1] for c in counts.values()) + len(counts) + 1
    weights = {"word plain": 1.0, "word link": LEAST_WORD} | {f"{side}{n}": LEAST_TAG for n in BLOCKS for side in ("", "/")}
    for key, (a, b) in counts.items():
        if not a and key.lstrip("/") in BLOCKS:
            continue
        odds = math.log((a + 1) / inside) - math.log((b + 1) / outside)
        weights[key] = max(odds, LEAST_WORD) if key.startswith("word ") else max(min(odds, LEAST_TAG), MOST_TAG)
    edge = -EDGE * max(1.0, weights["word plain"])
    return weights | marks | {f"{side}{n}": edge for n in CONTENT for side in ("", "/")}


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last index of the contiguous run with the largest sum, by one scan; the first of equals."""
    best, where, total, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i)
    return where


def extract(page: str | None, weights: dict[str, float]) -> str:
    events, _ = page_events(page, weights)
    scores, words = [], []
    for kind, key, piece, furniture, *_ in events:
        # character references may stand for white space, so they come first
        words.append(entities.unescape(piece) if kind == "text" and not furniture else "")
        if kind == "tag" and furniture:
            # its words are left out already: what lies behind it is not to be lost with it
            scores.append(LEAST_TAG)
        elif kind == "tag":
            scores.append(weights.get(key, -1.0))
        else:
            scores.append(weights["word " + key] * len(words[-1].split()))
    first, last = best_run(scores)
    blocks = {e[5] for e, w in zip(events[first : last + 1], words[first : last + 1], strict=True) if w.strip()}
    texts: dict[int, list[str]] = {}
    for e, w in zip(events, words, strict=True):
        if e[5] in blocks and w:
            texts.setdefault(e[5], []).append(w)
    joined = (" ".join("".join(parts).split()) for parts in texts.values())
    return "\n".join(t for t in joined if t)


def fit_weights(pages: DataFrame, most: int = FIT_PAGES) -> dict[str, float]:
    """Token weights from pages that mark their content with an article or main element.

    Fitted on a sample of about `most` pages, those with the smallest share of a hash of page_id;
    the tokens are the known tags, two kinds of words and those marks (element, class, id and role
    names) that at least MARK_PAGES of these pages have outside their content and none inside.
    """
    n = pages.count()
    share = F.pmod(F.xxhash64("page_id"), F.lit(max(1, n // most))) == 0
    read = pages.where(share & F.col("html").isNotNull()).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for b in batches:
            for page in b.column(0):
                for key, (a, c) in token_counts(page.as_py()).items():
                    found = sums.setdefault(key, [0, 0])
                    found[0] += a
                    found[1] += c
        rows = [(k, *v) for k, v in sorted(sums.items())]
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("token", "inside", "outside"))}, schema)

    schema = pa.schema([("token", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])
    parts = read.mapInArrow(run, "token string, inside long, outside long")
    sums = parts.groupBy("token").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    sums = sums.where(~F.col("token").startswith("mark ") | ((F.col("a") == 0) & (F.col("b") >= MARK_PAGES)))
    return weights_of({r["token"]: (r["a"], r["b"]) for r in sums.collect()})


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """All input columns plus `text`, the article of each page, and n_chars, its code points.

    `html` is read whole, in one scan that keeps words and tags in order and takes time in
    proportion to the page, unclosed tags and quotes included (what no ">" closes is text). Words
    score positive, tags negative (`fit_weights`), and what lies in menus, page headers and
    footers, sidebars, notices, adverts, forms or reader comments scores nothing: these are told
    by element, role, class and id names that labelled pages only have outside their content, and
    by lists of such names. The contiguous run with the best sum is the content; every block it touches is given
    whole, with character references decoded and white space as one space, joined by line feeds.

    A null or empty page, or one without words outside such parts, has an empty text. Repeated
    pages are read each; input columns named text or n_chars are replaced. The project lands
    pages of provider interfaces, not web pages, so this works on any page_id and html.
    """
    read = pages.drop("text", "n_chars")
    at = read.columns.index("html")
    schema = T.StructType([*read.schema.fields]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(page.as_py(), weights) for page in b.column(at)]
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.names)

    return read.mapInArrow(run, schema)
