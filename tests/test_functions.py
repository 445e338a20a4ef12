import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.functions import bands, keys, media, text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def test_escape_key_round_trip(spark):
    """Undoing the escapes gives the key back, and no slash or dot is left in an escaped one."""
    import itertools
    from urllib.parse import unquote

    raws = ["".join(c) for n in range(4) for c in itertools.product("%2./x", repeat=n)]
    df = spark.createDataFrame([(r,) for r in raws], "v string")
    for raw, escaped in df.select("v", keys.escape_key(F.col("v"))).collect():
        assert unquote(escaped) == raw and not set(escaped) & set("./")


@pytest.mark.parametrize("name", ["", "a", "65f0c0ffee", "ü/x"])
def test_uuid5(spark, name):
    assert one(spark, name, keys.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_OID, name))


@pytest.mark.parametrize("path", ["status", "inferences.m.other", "inferences.M.score", "importantTagProbs.eva02.x", "inferences.m.score;x"])
def test_unlisted_paths_are_refused(spark, path):
    with pytest.raises(ValueError):
        keys.resolve_path(spark.range(1), path)


def test_resolve_path_through_structs_and_maps(spark):
    df = spark.sql("SELECT named_struct('m-1', named_struct('score', 2.0D)) AS inferences, map('pixai', map('long hair', 0.5D)) AS importantTagProbs")
    assert df.select(keys.resolve_path(df, "inferences.m-1.score")).first()[0] == 2.0
    assert df.select(keys.resolve_path(df, "importantTagProbs.pixai.long hair")).first()[0] == 0.5
    assert df.select(keys.resolve_path(df, "importantTagProbs.pixai.other")).first()[0] is None


def test_ratings_outside_think_blocks(spark):
    """Random answers of plain text, bracketed numbers and think blocks: the first number outside a block counts."""
    import random

    r, rows = random.Random(12), []
    for i in range(300):
        parts, want = [], None
        for _ in range(r.randint(0, 5)):
            n, kind = r.choice([r.randint(0, 10), 10 ** r.randint(2, 20)]), r.choice(["text", "number", "think", "near"])
            if kind == "number":
                parts.append(f"[[{n}]]")
                want = n if want is None else want
            elif kind == "think":
                parts.append(f"<think>{r.choice(['', chr(10)])}so [[{n}]]{r.choice(['', chr(10), ' [[1]]'])}</think>")
            else:
                parts.append(f"[{n}] or [[ {n}]]" if kind == "near" else "words")
        rows.append((i, r.choice([" ", "", "\n"]).join(parts), want if want is None or want < 2**31 else None))
    df = spark.createDataFrame([r[:2] for r in rows], "i int, t string")
    got = {x["i"]: x["r"] for x in df.select("i", text.parse_rating(F.col("t")).alias("r")).collect()}
    assert got == {i: want for i, _, want in rows}


def distinct_words(n, letters=3):
    """n different words without a repeated pattern."""
    return ["".join(chr(97 + (i // 26**k) % 26) for k in range(letters)) + str(i) for i in range(n)]


@pytest.mark.parametrize("size,repeats", [(s, t) for s in (2, 3, 4, 49, 50, 51) for t in (1, 2, 3, 4)])
def test_phrases_on_both_sides_of_the_bounds(size, repeats):
    """Phrases of 3 to 50 words of at least ten characters, three times or more, and not at the very end of the text."""
    unit, tail = distinct_words(size, 4), [w.upper() for w in distinct_words(3 * size + 5)]
    found, phrase, times = text.find_loop(" ".join(unit * repeats + tail))
    assert found is (3 <= size <= 50 and repeats >= 3)
    if found:
        assert (phrase, times) == (" ".join(unit), repeats)


@pytest.mark.parametrize("length", [8, 9, 10, 11])
def test_short_phrases_do_not_count(length):
    unit = ["x", "y", "z" * (length - 4)]
    rest = [w.upper() for w in distinct_words(12)]
    assert text.find_loop(" ".join(unit * 3 + rest))[0] is (length >= 10)


@pytest.mark.parametrize("run", [28, 29, 30, 31])
def test_runs_of_one_character(run):
    """Texts shorter than thirty characters are not looked at."""
    assert text.find_loop("#" * run)[0] is (run >= 30)


@pytest.mark.parametrize("sample", [None, *["x" * n for n in range(0, 30, 7)]])
def test_too_little_text_is_no_loop(sample):
    assert text.find_loop(sample) == (False, None, 0)


def slow_repeat(seq, size, repeats):
    for i in range(len(seq) - 3 * size):
        n = 1
        while seq[i + n * size : i + (n + 1) * size] == seq[i : i + size]:
            n += 1
        if n >= repeats:
            return seq[i : i + size], n
    return None


@settings(max_examples=200, deadline=None)
@given(st.text("ab .", max_size=20), st.text("ab c", min_size=1, max_size=12), st.integers(1, 12), st.text("abc", max_size=15))
def test_patterns_against_a_slow_scan(head, unit, times, tail):
    sample = head + unit * times + tail
    if len(sample) < 30 or len(sample.split()) >= 5:
        return
    want = next((h for h in (slow_repeat(sample, n, 6) for n in range(2, 20)) if h), None)
    if want:
        assert text.find_loop(sample) == (True, *want)


def test_batches_give_the_same_as_single_texts():
    import random

    random.seed(5)
    word = lambda: "".join(random.choice("ab") for _ in range(random.randint(1, 3)))
    texts = [None, "", "short"]
    for _ in range(1500):
        unit = " ".join(word() for _ in range(random.randint(1, 6)))
        noise = lambda: "".join(random.choice("abcdefg h.") for _ in range(random.randint(0, 60)))
        texts.append(noise() + unit * random.randint(1, 8) + random.choice(["", " " + unit]) * random.randint(0, 5) + noise())
    want = [text.find_loop(t) for t in texts]
    assert 100 < sum(w[0] for w in want) < 1400
    for letters in (50, 1000, 10**9):
        assert text.find_loops(texts, letters) == want


def test_clean_lines(spark):
    assert one(spark, "# Title\n\n\nfirst\n  # note\n\n\n\nsecond\n\n", text.clean_lines) == "first\n\nsecond"


def test_json_envelope(spark):
    parse = lambda c: text.parse_json_envelope(c, "a int, b string", ["a"])["a"]
    assert one(spark, 'Sure: {"a": 3, "b": "x"} done', parse) == 3
    for bad in ('{"b": "x"}', "none", "} {", "[1]", None, '{"a": 1'):
        assert one(spark, bad, parse) is None


def test_category_json(spark):
    rows = ['```json\n{"hat": " Character "}\n```', 'So: {"run": "situation", "odd": "thing"} end', "no json", None]
    df = spark.createDataFrame([(r,) for r in rows], "response string")
    got = {r["tag"]: r["category"] for r in text.parse_category_json(df).collect()}
    assert got == {"hat": "character", "run": "situation", "odd": "other"}


@pytest.mark.parametrize("value,band", [(None, "Unknown"), (2, "Safe"), (3, "Slightly Suggestive"), (6, "Sensitive"), (8, "Adult"), (9, "Explicit")])
def test_rating_band(spark, value, band):
    assert one(spark, value, bands.rating_band, "int") == band


def test_rank_weight_bounds(spark):
    df = spark.createDataFrame([(1, 50), (50, 50), (None, 50), (1, 0)], "r int, t int")
    got = [r[0] for r in df.select(bands.rank_weight(F.col("r"), F.col("t"))).collect()]
    assert got[0] == 100 and 0 < got[1] < 1e-20 and got[2:] == [0, 0]


def test_image_sizes():
    import struct

    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 10, 20)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 8
    webp = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert [media.image_size(b) for b in (png, gif, jpeg, webp)] == [(640, 480), (10, 20), (40, 30), (100, 50)]
    for bad in (b"", None, b"abc", png[:18], b"\xff\xd8\xff"):
        assert media.image_size(bad) is None
