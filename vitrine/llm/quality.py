"""Quality rules for captions: one table of thresholds compiled into one projection."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Frequent function words of the languages the rules know.
STOP_WORDS = (
    "the of and to a in is that for it as was with be by on not he this are or at from have an which you were "
    "de la le les et des en un une du que qui dans pour pas sur au par est avec ce il se plus "
    "der die und das den von zu mit sich dem nicht ein eine als auch es an auf für im ist "
    "el los las y con una su para del lo como más pero sus al o si no"
).split()


@dataclass(frozen=True)
class Rule:
    """`least` <= 100 * `metric` / `over` <= `most`, for captions of at least `after` words."""

    name: str
    metric: str
    over: str
    least: int | None = None
    most: int | None = None
    after: int = 1


RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("capitals", "n_capitals", "word_chars", most=40),
    Rule("stop_words", "n_stop_words", "n_words", least=2, after=30),
    Rule("echoes", "n_echo_words", "n_words", most=30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
)
BASE = (
    Rule("words", "n_words", "one", least=1000),
    Rule("repeated_words", "n_repeat_words", "n_words", most=20),
)
METRICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_echo_words", "n_capitals",
)
STEPS = ("_text", "_words", "_lines", "_grams", "_sorted", "_places")


def _measured(captions: DataFrame) -> DataFrame:
    """The counts as columns; each step reads the one before, so nothing is computed twice."""
    q = captions.withColumn("_text", F.coalesce(F.col("caption"), F.lit("")))
    words = F.filter(F.split("_text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike(WORD))
    q = q.withColumns({"_words": words, "_lines": lines})
    hashed = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    none = F.array().cast("array<bigint>")
    q = q.withColumn("_grams", F.when(F.size("_words") >= WINDOW, F.transform(starts, hashed)).otherwise(none))
    # only captions with a repeated window are sorted; a window found twice then stands beside its equal
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    placed = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    q = q.withColumn("_sorted", F.when(repeats, placed).otherwise(F.array()))
    hash_at = lambda i: F.get("_sorted", i)["h"]
    twice = lambda g, i: ((i > 0) & (hash_at(F.greatest(i - 1, F.lit(0))) == g["h"])) | F.coalesce(hash_at(i + 1) == g["h"], F.lit(False))
    q = q.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", twice), lambda g: g["at"])))
    # each covers its words up to the start of the next one
    covered = F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW))))
    matched = lambda pattern: F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))
    stops = {w for s in STOP_WORDS for w in (s, s.capitalize())}
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": matched(f"[{SYMBOLS}]+"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x),
        "n_lines": F.size("_lines"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(sorted(stops)))),
        "n_echo_words": F.size(F.filter("_words", lambda w, i: (i > 0) & (w == F.get("_words", F.greatest(i - 1, F.lit(0)))))),
        "n_capitals": matched(r"\p{Lu}+"),
    }
    # a generator, as a filter on the counts must not be moved below the steps and repeat them
    row = F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])
    kept = [F.col(f"`{c}`") for c in captions.columns if c not in (*METRICS, *STEPS)]
    return q.select(*kept, F.inline(F.array(row)))


def verdict(rules: Iterable[Rule]) -> Column:
    """One condition that holds if every rule is kept, in whole numbers only."""
    kept = F.lit(True)
    for r in rules:
        amount, whole = F.col(r.metric) * 100, F.lit(1) if r.over == "one" else F.col(r.over)
        inside = F.lit(True)
        if r.least is not None:
            inside = inside & (amount >= whole * r.least)
        if r.most is not None:
            inside = inside & (amount <= whole * r.most)
        kept = kept & (inside if r.after <= 1 else (F.col("n_words") < r.after) | inside)
    return kept


def caption_quality(captions: DataFrame, rules: Iterable[Rule] = RULES, base: Iterable[Rule] = BASE) -> DataFrame:
    """Counts and verdict of every caption text: item_id, ... plus n_words to n_capitals, base_failed, kept.

    Reads `caption`, whole; all other columns are handed on. One projection of built-in
    functions: no shuffle, no join, no user code, and the cost of a caption grows as its length
    times the logarithm of it. The rule table is data; pass another to change the thresholds.

    A null caption is one without words, so it fails the base rules. Repeated rows are judged
    alone, an empty table gives an empty table. A column named like a result is replaced, as is
    one named like a step (`_text`, `_words`, `_lines`, `_grams`, `_sorted`, `_places`).
    """
    measured = _measured(captions.drop("base_failed", "kept"))
    return measured.withColumn("base_failed", ~verdict(base)).withColumn("kept", ~F.col("base_failed") & verdict(rules))
