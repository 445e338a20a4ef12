"""Model outputs and other free text; whole texts, JVM expressions but for the loop check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import values as V


def split_tag_string(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def parse_rating(text: Column) -> Column:
    """First `[[n]]` outside think blocks, else null."""
    spoken = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(spoken, r"\[\[(\d+)\]\]", 1), F.lit("")).try_cast("int")


def parse_json_envelope(text: Column, schema: str, required: list[str]) -> Column:
    """The JSON object between the first and the last brace, null without all required keys."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    keys = F.json_object_keys(body)
    complete = F.array_size(F.array_intersect(keys, F.array(*[F.lit(k) for k in required]))) == len(set(required))
    return F.when(complete, F.from_json(body, schema))


def parse_category_json(responses: DataFrame, column: str = "response") -> DataFrame:
    """tag, category pairs of model responses: fences cut, brace block as fallback, unknown is other."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(column), r"^```[a-z]*\n?", ""), r"\n?```$", ""))
    kind = "map<string,string>"
    whole, block = F.from_json(text, kind), F.from_json(F.regexp_extract(text, r"(?s)\{.+\}", 0), kind)
    category = F.lower(F.trim("category"))
    known = [*V.AXES, "other"]
    return (
        responses.select(F.explode(F.coalesce(whole, block)).alias("tag", "category"))
        .select("tag", F.when(category.isin(known), category).otherwise("other").alias("category"))
    )


def categorize(vocabulary: DataFrame, categories: DataFrame) -> DataFrame:
    """Every tag of the vocabulary; those without category are other."""
    one = categories.groupBy("tag").agg(F.max("category").alias("category"))
    return vocabulary.join(one, "tag", "left").withColumn("category", F.coalesce("category", F.lit("other")))


def clean_lines(text: Column) -> Column:
    """No heading lines, at most one blank line in a row, trimmed."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda l: ~l.rlike(r"^\s*#")), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"\n{2,}", "\n\n"), r"^\s+|\s+$", "")


def _first_repeat(codes: np.ndarray, size: int, repeats: int, allowed: np.ndarray | None = None):
    """(start, times) of the first block of `size` symbols repeated often enough, or None."""
    starts = len(codes) - size * V.PHRASE_REPEATS
    if starts <= 0:
        return None
    # a block at i repeats r times if positions i.. equal their successor one block on, (r - 1) * size in a row
    equal, need = np.flatnonzero(codes[:-size] == codes[size:]), (repeats - 1) * size
    if len(equal) < need:
        return None
    at = np.flatnonzero(equal[need - 1 :] - equal[: len(equal) - need + 1] == need - 1)
    at = at[equal[at] < starts]
    if allowed is not None:
        at = at[allowed[equal[at]]]
    if not len(at):
        return None
    rest = equal[at[0] :]
    gaps = np.flatnonzero(np.diff(rest) != 1)
    run = gaps[0] + 1 if len(gaps) else len(rest)
    return rest[0], int(1 + run // size)


def find_loop(text: str | None) -> tuple[bool, str | None, int]:
    """(is a loop, repeated phrase, times) of one text."""
    if not text or len(text) < V.PHRASE_CHARS * V.PHRASE_REPEATS:
        return False, None, 0
    words = text.split()
    if len(words) >= 5:
        codes = pd.factorize(np.array(words, dtype=object))[0]
        ends = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
        low, high = V.PHRASE_WORDS
        for size in range(low, min(high, len(words) // V.PHRASE_REPEATS) + 1):
            long_enough = ends[size:] - ends[:-size] - 1 >= V.PHRASE_CHARS
            hit = _first_repeat(codes, size, V.PHRASE_REPEATS, long_enough)
            if hit:
                return True, " ".join(words[hit[0] : hit[0] + size]), hit[1]
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for size in range(V.PATTERN_CHARS[0], V.PATTERN_CHARS[1] + 1):
        hit = _first_repeat(letters, size, V.PATTERN_REPEATS)
        if hit:
            return True, text[hit[0] : hit[0] + size], hit[1]
    breaks = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    bounds = np.concatenate([[0], breaks, [len(letters)]])
    for i in np.flatnonzero(np.diff(bounds) >= V.CHAR_RUN):
        if text[bounds[i]].strip():
            return True, text[bounds[i]], int(bounds[i + 1] - bounds[i])
    return False, None, 0


def _probe(codes: np.ndarray, starts: np.ndarray, sizes: tuple[int, int], repeats: int, width: int) -> np.ndarray:
    """Which of the joined sequences (beginning at `starts`) may hold a repeated block.

    A repeat makes (repeats - 1) * size positions in a row equal to the one a block on. Looking at
    `width` of them at every `step` cannot miss such a row, and costs a fraction of a full scan.
    """
    found = np.zeros(len(starts), dtype=bool)
    for size in range(sizes[0], sizes[1] + 1):
        step, end = (repeats - 1) * size - width + 1, len(codes) - size - width + 1
        if end <= 0:
            break
        same = np.ones(-(-end // step), dtype=bool)
        for j in range(width):
            same &= codes[j : end + j : step] == codes[size + j : size + end + j : step]
        found[np.searchsorted(starts, np.flatnonzero(same) * step, side="right") - 1] = True
    return found


def may_loop(texts: list[str]) -> np.ndarray:
    """Texts worth the exact check; a superset of those with a loop."""
    words = [t.split() for t in texts]
    begin = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    codes = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))[0]
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    by_word = _probe(codes, begin(words), V.PHRASE_WORDS, V.PHRASE_REPEATS, 4)
    # a long run of one character is also a repeated pair
    return by_word | _probe(letters, begin(texts), V.PATTERN_CHARS, V.PATTERN_REPEATS, 8)


def find_loops(texts: list[str | None], letters: int = 4_000_000) -> list[tuple[bool, str | None, int]]:
    """`find_loop` of many texts; about `letters` of them are probed together."""
    out = [(False, None, 0)] * len(texts)
    long_enough = [i for i, t in enumerate(texts) if t and len(t) >= V.PHRASE_CHARS * V.PHRASE_REPEATS]
    part, size = [], 0
    for n, i in enumerate(long_enough, start=1):
        part.append(i)
        size += len(texts[i])
        if size >= letters or n == len(long_enough):
            for k in np.flatnonzero(may_loop([texts[j] for j in part])):
                out[part[k]] = find_loop(texts[part[k]])
            part, size = [], 0
    return out


def repetition(text: Column) -> Column:
    """Loop check on Arrow batches of whole texts."""

    @F.pandas_udf("is_loop boolean, phrase string, times int")
    def check(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame(find_loops(batch.tolist()), columns=["is_loop", "phrase", "times"])

    return check(text)


def repetition_filter(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds is_loop, phrase and times."""
    checked = df.withColumn("_r", repetition(F.col(text)))
    return checked.select(*df.columns, "_r.is_loop", "_r.phrase", "_r.times")
