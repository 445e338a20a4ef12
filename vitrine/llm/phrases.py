"""Phrases of captions whose words keep company: Rabin-Karp fingerprints bring equal runs together, the text proves them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.scale import skew_join, stored, top_per_group

UNKNOWN = "und"
LONGEST = 4
# Two polynomials over bytes, each modulo 2**31 - 1: a fingerprint has 62 bits.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 48_271_069)
BITS = 62
# Bytes hashed at a time, so that a block stays in the cache: its products sum up to less than 2**55.
BLOCK = 1 << 16
# Text cut into words at a time, and text of runs in one Arrow batch.
TEXT = 1 << 20
# Size of the filter of frequent fingerprints, and bytes of it that one row carries: 8 MB and 16 KB whatever the data holds.
FILTER_BITS = 1 << 26
ROW_BYTES = 1 << 14
# Runs up to this long are compared eight bytes at a time for all, longer ones one by one; what counts of eight bytes if j are left.
SHORT = 96
MASK = np.array([(1 << 8 * j) - 1 for j in range(9)], dtype=np.uint64)
BREAKS = b".,;:!?\n\x0b\x0c\r"
KIND = bytes(2 if byte in BREAKS else byte in b" \t" for byte in range(256))
_P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for x up to PRIME * (PRIME - 1), by shifts instead of divisions; x is used up."""
    high = x >> np.uint64(31)
    x &= _P
    x += high
    return np.minimum(x, x - _P, out=x)


def _powers(base: int) -> np.ndarray:
    out = np.empty(BLOCK, dtype=np.uint64)
    out[0], n = 1, 1
    while n < BLOCK:
        step = np.uint64(pow(base, n, PRIME))
        more = min(n, BLOCK - n)
        out[n : n + more] = _mod(out[:more] * step)
        n += more
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse below BLOCK."""
    if base not in _tables:
        _tables[base] = _powers(base), _powers(pow(base, -1, PRIME))
    return _tables[base]


@dataclass
class Words:
    """The words of some captions: `text` holds each followed by one space, [start, end) its place; a phrase keeps to one piece and one language."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]
    prefix: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    eight: np.ndarray | None = None


def words_of(captions: list[bytes | None], langs: list[str | None]) -> Words:
    """Lower-cased (A-Z) words of whole captions, their pieces numbered through."""
    raw = b"\n".join([c or b"" for c in captions]) + b"\n"
    kind = np.frombuffer(raw.translate(KIND), dtype=np.uint8)
    inside = kind == 0
    # a word begins and ends where `inside` changes; every caption ends in a break
    edges = np.nonzero(np.diff(inside, prepend=False))[0]
    first, last = edges[0::2], edges[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[first]
    # every word and the first byte after it stay, so that one byte lies between any two
    kept = inside.copy()
    kept[last] = True
    text = np.frombuffer(raw.lower(), dtype=np.uint8).copy()
    text[last] = 0x20
    text = text[kept]
    end = np.cumsum(last - first + 1) - 1
    start = end - (last - first)
    sizes = np.array([len(c or b"") + 1 for c in captions], dtype=np.int64)
    row = np.searchsorted(np.cumsum(sizes), first, side="right")
    names = [UNKNOWN if n is None else n for n in langs]
    distinct = sorted(set(names))
    code = np.array([distinct.index(n) for n in names], dtype=np.int64)
    return Words(text, start, end, piece, code[row] if len(row) else np.empty(0, dtype=np.int64), distinct)


def prefixes(words: Words) -> None:
    """Prefix polynomials at the words' starts and ends, with the inverse power at each start; bytes are read block by block."""
    for base in BASES:
        power, inverse = _table(base)
        # a start, its end, the next start: in order
        at = np.stack([words.start, words.end], axis=1).ravel()
        value = np.zeros(len(at), dtype=np.uint64)
        carried, factor = np.uint64(0), np.uint64(1)
        whole = np.uint64(pow(base, BLOCK, PRIME))
        for low in range(0, len(words.text), BLOCK):
            block = words.text[low : low + BLOCK]
            local = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(block * power[: len(block)], dtype=np.uint64)])
            here = slice(np.searchsorted(at, low), np.searchsorted(at, low + len(block)))
            value[here] = _mod(_mod(local[at[here] - low]) * factor + carried)
            carried = (carried + local[-1] % _P * factor) % _P
            factor = factor * whole % _P
        blocks = np.array([pow(base, -BLOCK * int(b), PRIME) for b in range(len(words.text) // BLOCK + 1)], dtype=np.uint64)
        back = _mod(inverse[words.start % BLOCK] * blocks[words.start // BLOCK])
        words.prefix.append((value[0::2], value[1::2], back))


def fingerprints(words: Words, n: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of every run of n words in one piece; the language is part of the fingerprint."""
    if not words.prefix:
        prefixes(words)
    count = max(0, len(words.start) - n + 1)
    first = np.nonzero(words.piece[:count] == words.piece[n - 1 : n - 1 + count])[0]
    parts = []
    for low, high, back in words.prefix:
        parts.append(_mod(_mod(high[first + n - 1] + _P - low[first]) * back[first]))
    salts = np.array([xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) for name in words.langs], dtype=np.uint64)
    key = ((parts[0] << np.uint64(31)) | parts[1]) ^ salts[words.lang[first]]
    return first, (key & np.uint64((1 << bits) - 1)).view(np.int64)


def read_words(batch: pa.RecordBatch) -> Iterator[Words]:
    """Words of a batch of (caption, lang), several captions at a time up to a few blocks of text."""
    captions, langs, size = [], [], 0
    for text, lang in zip(batch.column(0).cast(pa.large_binary()), batch.column(1), strict=True):
        value = text.as_py()
        captions.append(value)
        langs.append(lang.as_py())
        size += len(value or b"")
        if size > TEXT:
            yield words_of(captions, langs)
            captions, langs, size = [], [], 0
    if captions:
        yield words_of(captions, langs)


def marked(table: np.ndarray, keys: np.ndarray, filter_bits: int) -> np.ndarray:
    """Which keys may be in the filter: all that were put in, and few others."""
    at = keys & (filter_bits - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def counted(captions: DataFrame, choose: Callable[[Words], Iterator[tuple[int, np.ndarray, np.ndarray]]], words_too: bool = False) -> DataFrame:
    """run, n of the runs that `choose` takes (words, first word, fingerprint), summed in the tasks before the shuffle.

    With `words_too` the empty run of every language counts its words.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in read_words(batch):
                if words_too:
                    runs = pa.array(["\n" + name for name in words.langs], pa.string())
                    yield pa.RecordBatch.from_arrays([runs, pa.array(np.bincount(words.lang, minlength=len(words.langs)), pa.int64())], names=["run", "n"])
                for n, first, keys in choose(words):
                    yield from written(words, *proven(words, first, keys, n), n)

    return captions.mapInArrow(rows, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))


def filter_of(keys: DataFrame, filter_bits: int) -> Broadcast:
    """The keys (fp) as bits of one table of fixed size, made by tasks in rows of ROW_BYTES and sent to all."""
    words = keys.select((F.col("fp").bitwiseAND(filter_bits - 1)).alias("_at")).groupBy(F.shiftright("_at", 3).alias("_byte")).agg(
        F.bit_or(F.expr("shiftleft(1, CAST(_at & 7 AS INT))")).cast("short").alias("_bits")
    )

    def row(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(ROW_BYTES, dtype=np.uint8)
        table[pdf["_byte"].to_numpy() % ROW_BYTES] = pdf["_bits"].to_numpy()
        return pd.DataFrame({"row": [int(pdf["_byte"].iloc[0] // ROW_BYTES)], "bits": [table.tobytes()]})

    rows = words.groupBy(F.expr(f"_byte div {ROW_BYTES}")).applyInPandas(row, "row long, bits binary")
    table = np.zeros(max(filter_bits // 8, ROW_BYTES), dtype=np.uint8)
    for r in rows.collect():
        table[r["row"] * ROW_BYTES : (r["row"] + 1) * ROW_BYTES] = np.frombuffer(r["bits"], dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def _same(words: Words, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the runs of `size` bytes at `a` and at `b` are equal, eight bytes at a time."""
    if words.eight is None:
        rows = len(words.text) // 8 + 1
        padded = np.concatenate([words.text, np.zeros(8 * rows + 8 - len(words.text), dtype=np.uint8)])
        words.eight = np.stack([np.frombuffer(padded, "<u8", rows, j) for j in range(8)], axis=1).ravel()
    equal = np.ones(len(a), dtype=bool)
    live, left = slice(None), size
    for j in range(0, min(int(size.max(initial=0)), SHORT), 8):
        if j:
            longer = np.nonzero(left > 8)[0]
            live, left = (longer if j == 8 else live[longer]), left[longer] - 8
        differ = (words.eight[a[live] + j] ^ words.eight[b[live] + j]) & MASK[np.minimum(left, 8)]
        equal[live] &= differ == 0
    for i in np.nonzero(equal & (size > SHORT))[0]:
        equal[i] = np.array_equal(words.text[a[i] : a[i] + size[i]], words.text[b[i] : b[i] + size[i]])
    return equal


def proven(words: Words, first: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, occurrences) of the distinct runs: occurrences of a fingerprint are put side by side, each is compared with the text before it.

    One that differs begins a row of its own, so runs that share a fingerprint are told apart; a text
    may then have several rows, which the shuffle sums.
    """
    if not len(keys):
        return first, keys
    # fingerprint and place are sorted as one number; the highest bits lost to the place can only make a comparison fail
    place = np.uint64(len(keys).bit_length())
    mixed = np.sort((keys.view(np.uint64) << place) | np.arange(len(keys), dtype=np.uint64))
    first = first[(mixed & ((np.uint64(1) << place) - np.uint64(1))).view(np.int64)]
    mixed >>= place
    start = words.start[first]
    size, lang = words.end[first + n - 1] - start, words.lang[first]
    pair = np.nonzero((mixed[1:] == mixed[:-1]) & (size[1:] == size[:-1]) & (lang[1:] == lang[:-1]))[0]
    head = np.ones(len(first), dtype=bool)
    head[pair + 1] = ~_same(words, start[pair], start[pair + 1], size[pair])
    at = np.nonzero(head)[0]
    return first[at], np.diff(at, append=len(first))


def written(words: Words, first: np.ndarray, found: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """run, n: the text of the runs with their language after a line end, which no run holds; in order of place, about TEXT bytes at a time."""
    order = np.argsort(first)
    first, found = first[order], found[order]
    names = [b"\n" + name.encode("utf-8", "surrogatepass") for name in words.langs]
    source = np.concatenate([words.text, np.frombuffer(b"".join(names), dtype=np.uint8)])
    length = np.array([len(name) for name in names], dtype=np.int64)
    name_at = len(words.text) + np.cumsum(length) - length
    lang = words.lang[first]
    starts = np.stack([words.start[first], name_at[lang]], axis=1)
    sizes = np.stack([words.end[first + n - 1] - words.start[first], length[lang]], axis=1)
    ends = np.cumsum(sizes.sum(axis=1))

    def cut(low: int, high: int, most: int) -> Iterator[tuple[int, int]]:
        """Rows low to high in groups of at most `most` bytes, or one row."""
        while low < high:
            before = ends[low - 1] if low else 0
            upto = min(high, max(low + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield low, upto
            low = upto

    for low, high in cut(0, len(first), TEXT):
        data = []
        for a, b in cut(low, high, BLOCK):
            size = sizes[a:b].ravel()
            end = np.cumsum(size)
            data.append(source[np.repeat(starts[a:b].ravel() - end + size, size) + np.arange(end[-1])])
        offsets = np.concatenate([[0], ends[low:high] - (ends[low - 1] if low else 0)]).astype(np.int32)
        runs = pa.Array.from_buffers(pa.string(), high - low, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))])
        yield pa.RecordBatch.from_arrays([runs, pa.array(found[low:high], pa.int64())], names=["run", "n"])


def pair_keys(phrases: DataFrame, bits: int) -> DataFrame:
    """fp of phrases (lang, phrase) of two words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in read_words(batch):
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(words, 2, bits)[1])], names=["fp"])

    return phrases.select("phrase", "lang").mapInArrow(rows, "fp long")


def frequent_phrases(captions: DataFrame, least: int = 30, longest: int = LONGEST, bits: int = BITS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, f of all phrases of up to `longest` words found `least` times or more, and one row per lang with the empty phrase: its words."""
    read = captions.select(F.col("caption").cast("binary").alias("caption"), F.col("lang").cast("string").alias("lang"))

    def often(runs: DataFrame) -> DataFrame:
        parts = [F.expr("substring(run, instr(run, '\n') + 1)").alias("lang"), F.substring_index("run", "\n", 1).alias("phrase"), F.col("n").alias("f")]
        return stored(runs.where((F.col("n") >= least) | F.col("run").startswith("\n")).select(*parts))

    def short(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n in range(1, min(longest, 2) + 1):
            yield n, *fingerprints(words, n, bits)

    found = often(counted(read, short, words_too=True))
    if longest > 2:
        pairs = filter_of(pair_keys(found.where("phrase LIKE '% %'"), bits), filter_bits)

        def longer(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            first, two = fingerprints(words, 2, bits)
            good = np.zeros(len(words.start) + longest, dtype=bool)
            good[first] = marked(pairs.value, two, filter_bits)
            for n in range(3, longest + 1):
                first, keys = fingerprints(words, n, bits)
                kept = np.logical_and.reduce([good[first + j] for j in range(n - 1)])
                yield n, first[kept], keys[kept]

        found = found.union(often(counted(read, longer)))
    return found


def _joined(words, low, size):
    return F.array_join(F.slice(words, low, size), " ")


def mine_phrases(
    captions: DataFrame,
    least: int = 30,
    longest: int = LONGEST,
    inside: int = 80,
    scale: int = 2_000_000,
    keep: int = 2000,
    bits: int = BITS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The strongest collocations of every language: lang, rank, phrase, a, l, r, n, score.

    Captions (caption, lang) are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends and
    these into words at spaces and tabs. n counts a language's words, f(phrase) its occurrences
    inside pieces. Phrases of 2 to `longest` words with a = f(phrase) >= `least` are candidates; cut
    after k words a phrase has l and r, the f of both parts, and floor(scale * a / (l + r)); the cut
    with the lowest score counts, then that with the smallest k. A candidate goes if a longer one
    holds its words side by side and has 100 f >= `inside` a. Of the rest the first `keep` of each
    language stay, by score and a (both falling) and phrase (bytes).

    Prefix polynomials over a task's bytes give the fingerprint of every run of words. Tasks put
    the occurrences of a fingerprint side by side and compare each with the text of the one before;
    a run leaves with its text and its occurrences, summed again before the shuffle. Counts are
    therefore exact whatever `bits` fingerprints have, and no text is read again for a proof. Runs
    of three and more words are shuffled if the pairs in them may be frequent, which a bit filter
    of fixed size (`filter_bits`) tells: it lets too many pass when it fills up, never too few, so
    results do not depend on it.

    A null caption is empty, a null lang is `und`. Repeated rows count each time, item ids are not
    read and other columns are ignored. No caption, or none with a frequent phrase: no rows.
    """
    counts = frequent_phrases(captions, least, longest, bits, filter_bits)
    words = F.split("phrase", " ")
    freq = counts.where("phrase <> ''")
    found = freq.select("lang", "phrase", F.col("f").alias("a"), words.alias("_w"), F.size(words).alias("_n")).where("_n > 1")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)).alias("_k")).select(
        "lang", "phrase", "a", "_k", _joined("_w", F.lit(1), F.col("_k")).alias("_left"), _joined("_w", F.col("_k") + 1, F.col("_n") - F.col("_k")).alias("_right")
    )
    part = lambda side, f: freq.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    both = skew_join(stored(cuts), part("_left", "l"), ["lang", "_left"], "inner", ["phrase", "_k"])
    both = skew_join(stored(both), part("_right", "r"), ["lang", "_right"], "inner", ["phrase", "_k"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.withColumns({"_top": F.lit(scale).cast("decimal(19,0)") * wide("a"), "_low": wide("l") + wide("r")})
    scored = scored.withColumn("score", F.expr("_top div _low"))
    best = scored.groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), F.min(F.struct("score", "_k", "l", "r")).alias("_best"))
    subs = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("_n") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.col("_n") - size + 1), lambda low: F.array_join(F.slice("_w", low, size), " ")),
        )
    )
    holders = found.where("_n > 2").select("lang", F.explode(F.array_distinct(subs)).alias("phrase"), "a")
    held = holders.groupBy("lang", "phrase").agg(F.max("a").alias("_held"))
    kept = best.join(held, ["lang", "phrase"], "left").where(
        F.col("_held").isNull() | (F.lit(100).cast("decimal(5,0)") * wide("_held") < F.lit(inside).cast("decimal(5,0)") * wide("a"))
    )
    rows = stored(kept.select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    ranked = top_per_group(rows, ["lang"], order, keep)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
