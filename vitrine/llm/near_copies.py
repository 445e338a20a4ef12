"""Near copies among captions: SimHash fingerprints linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.scale import skew_join, stored

SHINGLE = 4
SEED = 42
BITS = 64
# Words hashed at a time, and ball members expanded at a time, inside one task.
PIECE = 1 << 16
BALL_ROWS = 1 << 21
# Fingerprints of one prefix that stay in one task, and bits by which more of them are dealt on.
PREFIX_ROWS = 1 << 16
STEP = 8
OWN = ("fingerprint", "component_id", "representative", "_fp", "_row")


def simhash(text: bytes | None) -> int:
    """Unsigned fingerprint of a UTF-8 text: bit i is 1 if more than half of the shingle hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts, total = np.zeros(BITS, dtype=np.int64), len(words) - SHINGLE + 1
    for start in range(0, total, PIECE):
        piece = words[start : start + PIECE + SHINGLE - 1]
        runs = zip(*(piece[k:] for k in range(SHINGLE)), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def with_fingerprints(captions: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and _fp, the fingerprint as a signed long."""
    read = captions.select(*[F.col(f"`{c}`") for c in keep], F.col("caption").cast("binary").alias("_text"))
    schema = T.StructType([f for f in read.schema.fields if f.name != "_text"]).add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            marks = np.fromiter((simhash(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            columns = [*b.columns[:-1], pa.array(marks)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "_fp"])

    return read.mapInArrow(run, schema)


def flips(first: int, most: int) -> np.ndarray:
    """Masks of at most `most` ones among the bits below position BITS - first (the top bit is position 0)."""
    ones = [1 << (BITS - 1 - b) for b in range(first, BITS)]
    return np.array([sum(c) for k in range(most + 1) for c in itertools.combinations(ones, k)], dtype=np.uint64)


def ball_labels(marks: np.ndarray, spare: np.ndarray, first: int, distance: int, limit: int = BALL_ROWS) -> np.ndarray:
    """For each fingerprint the index of a smaller or equal one it is linked to.

    `spare` is how many of the bits from `first` on a variant may still differ in. All variants
    are formed, sorted, and the owners of equal ones linked; while there are more than `limit`,
    the variants are split by their next bit and each half is done alone.
    """
    labels = np.arange(len(marks))

    def link(at: np.ndarray, left: np.ndarray, bit: int) -> None:
        if len(at) < 2:
            return
        free = BITS - bit
        size = sum(int((left >= k).sum()) * math.comb(free, k) for k in range(int(left.max()) + 1))
        if size > limit and bit < BITS:
            up = (marks[at] >> np.uint64(BITS - 1 - bit)) & np.uint64(1)
            for value in (0, 1):
                rest = left - (up != value)
                link(at[rest >= 0], rest[rest >= 0], bit + 1)
            return
        # the bits before `bit` are those of the branch, the same for all
        rest = marks & np.uint64((1 << free) - 1)
        parts = [(at[left == r], flips(bit, r)) for r in np.unique(left)]
        variants = np.concatenate([(rest[own][:, None] ^ masks[None, :]).ravel() for own, masks in parts])
        owners = np.concatenate([np.repeat(own, len(masks)) for own, masks in parts])
        order = np.argsort(variants, kind="stable")
        variants, owners = variants[order], owners[order]
        same = variants[1:] == variants[:-1]
        if not same.any():
            return
        # neighbours of one variant: at most half the distance from it each, checked all the same
        a, b = owners[:-1][same], owners[1:][same]
        pairs = np.unique(np.minimum(a, b) * len(marks) + np.maximum(a, b))
        a, b = pairs // len(marks), pairs % len(marks)
        near = (np.bitwise_count(marks[a] ^ marks[b]) <= distance) & (a != b)
        join(a[near], b[near])

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low = np.minimum(labels[a], labels[b])
            before = labels.copy()
            np.minimum.at(labels, labels[a], low)
            np.minimum.at(labels, labels[b], low)
            np.minimum(labels, labels[labels], out=labels)
            if (before == labels).all() and (labels[a] == labels[b]).all():
                return

    link(np.arange(len(marks)), spare, first)
    while (labels != labels[labels]).any():
        labels = labels[labels]
    return labels


def dealt(distinct: DataFrame, half: int, prefix: int, most: int = PREFIX_ROWS) -> list[tuple[int, DataFrame]]:
    """(p, rows of _fp, _prefix): every word within `half` bits of a fingerprint has its first p bits in one of these tables.

    All fingerprints are dealt by their words' first `prefix` bits. A prefix with more than `most`
    of them is dealt again by STEP further bits, in which only the differences still to spare may
    lie, and so on down to whole words, each of which is near to 2081 fingerprints at most (for
    half = 2). Prefixes are counted before the shuffle, so no group is ever gathered to be split.
    """
    masks = [int(m) >> (BITS - prefix) for m in flips(0, half) if int(m) & ((1 << (BITS - prefix)) - 1) == 0]
    start = F.shiftrightunsigned("_fp", BITS - prefix)
    rows = distinct.select("_fp", F.explode(F.array(*[start.bitwiseXOR(F.lit(m).cast("long")) for m in masks])).alias("_prefix"))
    levels = []
    while prefix < BITS:
        large = stored(rows.groupBy("_prefix").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_prefix", F.lit(True).alias("_large")))
        if large.isEmpty():
            break
        told = stored(skew_join(rows, large, ["_prefix"], "left", ["_fp"]))
        levels.append((prefix, told.where("_large IS NULL").drop("_large")))
        step = min(STEP, BITS - prefix)
        spare = half - F.bit_count(F.shiftrightunsigned("_fp", BITS - prefix).bitwiseXOR(F.col("_prefix")))
        flipped = F.filter(F.array(*[F.lit(m).cast("long") for m in range(1 << step) if m.bit_count() <= half]), lambda m: F.bit_count(m) <= spare)
        prefix += step
        further = F.shiftrightunsigned("_fp", BITS - prefix).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
        longer = F.shiftleft("_prefix", step).bitwiseOR(further.bitwiseXOR(F.col("_flip"))).alias("_prefix")
        rows = told.where("_large").select("_fp", "_prefix", F.explode(flipped).alias("_flip")).select("_fp", longer)
    return [*levels, (prefix, rows)]


def fingerprint_links(distinct: DataFrame, distance: int = 4, ball_rows: int = BALL_ROWS, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """a, b (a > b as unsigned order of no meaning): links that connect all fingerprints within `distance` bits.

    Two fingerprints are that near exactly if some 64-bit word lies within half the distance of
    both. Each fingerprint stands for all such words (2081 at distance 4). The words are dealt by
    their first p bits: a fingerprint is sent once to each prefix its words have (1 + p +
    p (p - 1) / 2 rows of eight bytes, not 2081), and the task of a prefix forms the words that
    begin with it. p grows with the number of fingerprints, so that a task forms about
    `ball_rows` words; denser ones are done piece by piece. A prefix of more than `prefix_rows`
    fingerprints, as around a text with very many slight variants, is dealt on by further bits.

    The words a prefix shares give links inside it; of these only one per fingerprint leaves the
    task, to the first fingerprint it is connected to. So a group of n fingerprints never makes
    more than n rows per prefix.
    """
    if distance < 2 or distance % 2:
        raise ValueError("distance must be even, from 2")
    half = distance // 2
    words = sum(math.comb(BITS, k) for k in range(half + 1))
    first = min(24, max(1, math.ceil(math.log2(max(2, distinct.count() * words / ball_rows)))))

    def links(prefix: int, rows: DataFrame) -> DataFrame:
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            marks = np.sort(rows["_fp"].to_numpy().view(np.uint64))
            shared = np.int64(key[0]).view(np.uint64)
            spare = half - np.bitwise_count((marks >> np.uint64(BITS - prefix)) ^ shared).astype(int)
            labels = ball_labels(marks, spare, prefix, distance, ball_rows)
            linked = np.nonzero(labels != np.arange(len(marks)))[0]
            return pd.DataFrame({"a": marks[linked].view(np.int64), "b": marks[labels[linked]].view(np.int64)})

        return rows.groupBy("_prefix").applyInPandas(run, "a long, b long")

    return reduce(DataFrame.union, [links(p, rows) for p, rows in dealt(distinct, half, first, prefix_rows)])


def connected(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: the smallest node of each component that `links` (a, b) form.

    Large-star and small-star steps alternate until the links are stars, each node linked to its root
    alone: every step moves the links of a node to its smallest neighbour, as joins and minima. Stars
    are told by one count per node, so no round is spent to see that nothing changes. Each round is
    written to the shared folder. The smallest of a node's neighbours is a minimum combined before the shuffle; the
    join that hands it to all neighbours is a plain equi join, which adaptive execution splits.
    """

    def tidy(edges: DataFrame) -> tuple[DataFrame, bool]:
        rows = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        ends = F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("up")) for c, up in (("a", 1), ("b", 0))]))
        seen = rows.select(ends).groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        return rows, not seen.agg(F.max(F.expr("ups > 1 OR (ups = 1 AND low = 0)"))).first()[0]

    edges, stars = tidy(links)
    for _ in range(rounds):
        if stars:
            break
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # many neighbours hand a node the same smallest one: once is enough, before anything meets by node
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", "m"))
        edges, stars = tidy(small)
    if not stars:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _hex(mark: Column) -> Column:
    return F.lpad(F.lower(F.hex(mark)), 16, "0")


def with_best(rows: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """`rows` with _best, the least _first of the `distinct` (_fp, _first) their _fp is connected to by `roots`."""
    linked = roots.join(distinct, roots.node == distinct["_fp"]).select("_fp", "root", "_first")
    firsts = linked.groupBy("root").agg(F.min("_first").alias("_best"))
    labels = linked.join(firsts, "root").select("_fp", "_best")
    groups = distinct.join(labels, "_fp", "left").select("_fp", F.coalesce("_best", "_first").alias("_best"))
    return skew_join(rows, groups, ["_fp"], "inner", ["_row"])


def near_copies(captions: DataFrame, distance: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Captions with their group of near copies: the columns `keep` (all by default) plus
    fingerprint (16 hex digits), component_id, representative.

    A fingerprint is the SimHash of the lower-cased (A-Z) four-word shingles of the whole caption
    under XXH64; fingerprints at most `distance` bits apart are linked, exactly
    (`fingerprint_links`). component_id is the smallest item_id that links reach, and
    `representative` is true for one row of each group, that with the smallest item_id.

    Texts are read once, where they lie. Equal captions meet as one fingerprint before any
    linking, and a hot fingerprint is salted when groups are joined back to the rows.

    A null or blank caption has fingerprint zero and is linked like any other. Null ids come last:
    a group of nothing else has a null component_id. Of repeated rows one is the representative.
    An empty table gives an empty table. Input columns named like a result are replaced.
    """
    columns = [c for c in (keep if keep is not None else captions.columns) if c not in OWN]
    carried = list(dict.fromkeys(["item_id", *columns]))
    marked = with_fingerprints(captions.drop(*[c for c in OWN if c in captions.columns]), carried)
    rows = stored(marked.withColumn("_row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("item_id").isNull().alias("n"), "item_id", "_row"))
    distinct = stored(rows.groupBy("_fp").agg(first.alias("_first")))
    roots = stored(connected(fingerprint_links(distinct.select("_fp"), distance)))
    joined = with_best(rows, distinct, roots)
    return joined.select(
        *[F.col(f"`{c}`") for c in columns],
        _hex(F.col("_fp")).alias("fingerprint"),
        F.col("_best.item_id").alias("component_id"),
        (F.col("_row") == F.col("_best._row")).alias("representative"),
    )
