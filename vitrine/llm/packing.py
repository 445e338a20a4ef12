"""Packing captions into token windows with lexical neighbours from a sharded BM25 index."""

from __future__ import annotations

import bisect
import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.scale import number_rows, stored

WINDOW = 1024
END = 0
# Tokens in one shard of the index, about.
SHARD_TOKENS = 1 << 21
K1, B = 1.2, 0.75
# Terms in a larger share of a shard's distinct captions are held as a dense matrix, the others as posting lists.
COMMON = 0.2
# Captions that the order of dealing is fitted on, about, and the characters read of each; no caption is dealt by less than all of it.
FIT_CAPTIONS, FIT_CHARS = 4000, 8192
# Dimensions of a caption's vector, depth of the tree over it, and inside a leaf the rarest tokens that count, with bits of each.
DIMENSIONS, DEPTH, KEY_TOKENS, KEY_BITS = 64, 8, 3, 18
# Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQUENCE = 1 << 32


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file, as the library that encodes it fastest wants it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or "ByteLevel" not in json.dumps(spec["pre_tokenizer"]):
        raise ValueError(f"{path} is not a byte-level BPE")
    # printable bytes stand for themselves, the others for the characters from 256 on
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=2)
def plain_encoder(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


def encode(enc: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """Ids of a whole text and the end id; one that the fast library gives up on, with a long run of white space, goes to the plain one."""
    try:
        ids = enc.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, dtype=np.uint32)
    except ValueError:
        ids = np.array(plain_encoder(enc.name).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return np.append(ids, np.uint32(END))


def _narrow(enc: tiktoken.Encoding) -> str:
    return "<u2" if enc.n_vocab <= 1 << 16 else "<u4"


@functools.lru_cache(maxsize=2)
def directions(vocabulary: int) -> np.ndarray:
    return np.random.default_rng(0).normal(size=(vocabulary, DIMENSIONS)).astype(np.float32)


class Dealer:
    """The order in which captions are dealt: a tree over their weighted vectors, then their rarest tokens.

    Fitted on a sample of token ids. Each node halves its captions along their main direction, so
    likely neighbours take the same path; inside a leaf the rarest tokens that two of the sample
    share decide. Copies have one key.
    """

    def __init__(self, sample: list[np.ndarray], vocabulary: int):
        found = [np.unique(i, return_counts=True) for i in sample]
        frequencies = np.zeros(vocabulary)
        for t, _ in found:
            frequencies[t] += 1
        self.idf = np.log1p((len(sample) - frequencies + 0.5) / (frequencies + 0.5)).astype(np.float32)
        self.mean_length = float(np.mean([len(i) for i in sample])) if sample else 1.0
        last = (1 << KEY_BITS) - 1
        self.ranks = np.full(vocabulary, last, dtype=np.int64)
        shared = np.nonzero(frequencies >= 2)[0]
        self.ranks[shared[np.argsort(frequencies[shared], kind="stable")]] = np.minimum(np.arange(len(shared)), last)
        # node k has its halves at 2 k + 1 and 2 k + 2
        self.normals = np.zeros(((1 << DEPTH) - 1, DIMENSIONS), dtype=np.float32)
        self.middles = np.full((1 << DEPTH) - 1, np.inf)
        if sample:
            self._split(np.array([self.vector(t, c) for t, c in found]), 0)

    def _split(self, vectors: np.ndarray, node: int) -> None:
        if node >= len(self.middles) or len(vectors) < 32:
            return
        normal = np.linalg.svd(vectors - vectors.mean(axis=0), full_matrices=False)[2][0]
        along = vectors @ normal
        self.normals[node], self.middles[node] = normal, np.median(along)
        up = along > self.middles[node]
        self._split(vectors[~up], 2 * node + 1)
        self._split(vectors[up], 2 * node + 2)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        length = counts.sum()
        weights = self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / self.mean_length))
        out = weights.astype(np.float32) @ directions(len(self.idf))[terms]
        return out / max(float(np.sqrt(out @ out)), 1e-9)

    def keys(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The keys of many captions, given as their (terms, counts); a level of the tree is one step for all of them."""
        vectors = np.array([self.vector(t, c) for t, c in found], dtype=np.float32).reshape(len(found), DIMENSIONS)
        node = np.zeros(len(found), dtype=np.int64)
        for _ in range(DEPTH):
            along = np.einsum("ij,ij->i", self.normals[node], vectors)
            node = 2 * node + 1 + (along > self.middles[node])
        rarest = np.full((len(found), KEY_TOKENS), (1 << KEY_BITS) - 1, dtype=np.int64)
        for row, (terms, _) in zip(rarest, found, strict=True):
            ranks = self.ranks[terms]
            least = np.partition(ranks, KEY_TOKENS)[:KEY_TOKENS] if len(ranks) > KEY_TOKENS else ranks
            row[: len(least)] = least
        rarest.sort(axis=1)
        out = node - len(self.middles)
        for k in range(KEY_TOKENS):
            out = out << KEY_BITS | rarest[:, k]
        return out


def fit_dealer(captions: DataFrame, tokenizer: str) -> Dealer:
    """Fitted on the driver, on about FIT_CAPTIONS captions by a hash of their row."""
    enc, n = encoder(tokenizer), captions.count()
    numbered = captions.select(F.substring("caption", 1, FIT_CHARS).alias("t"), F.monotonically_increasing_id().alias("r"))
    picked = numbered.where(F.pmod(F.xxhash64("r"), F.lit(max(1, n // FIT_CAPTIONS))) == 0).orderBy("r").select("t")
    return Dealer([encode(enc, r["t"]) for r in picked.collect()], enc.n_vocab)


def tokenised(captions: DataFrame, tokenizer: str) -> DataFrame:
    """item_id, _ids (binary), _n, _key of every caption, and per task one row with the document frequencies it saw."""
    read = captions.select("item_id", "caption")
    schema = T.StructType([read.schema["item_id"]]).add("_ids", "binary").add("_n", "long").add("_key", "long").add("_frequencies", "binary")
    dealer = captions.sparkSession.sparkContext.broadcast(fit_dealer(read, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind, seen, id_type = _narrow(enc), np.zeros(enc.n_vocab, dtype="<i8"), None
        for b in batches:
            id_type = b.column(0).type
            ids = [encode(enc, t.as_py()) for t in b.column(1)]
            found = [np.unique(i, return_counts=True) for i in ids]
            for t, _ in found:
                seen[t] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([i.astype(kind).tobytes() for i in ids], pa.binary()),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array(dealer.value.keys(found), pa.int64()),
                    pa.nulls(len(ids), pa.binary()),
                ],
                names=schema.names,
            )
        if id_type is not None:
            last = [pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([seen.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(last, names=schema.names)

    return read.mapInArrow(run, schema)


def document_frequencies(table: DataFrame, vocabulary: int) -> np.ndarray:
    """Captions holding each token, over the whole table; at most one number per token reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype="<i8")
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_py(), dtype="<i8")
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["token", "n"])

    parts = table.where("_frequencies IS NOT NULL").select("_frequencies").mapInArrow(run, "token int, n long")
    rows = parts.groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary)
    out[rows["token"].to_numpy(dtype=int)] = rows["n"].to_numpy(dtype=float)
    return out


def dealt(rows: DataFrame, shard_tokens: int) -> DataFrame:
    """`rows` with _shard: about `shard_tokens` tokens each, in order of _key and row.

    The keys alone are ranged and their tokens summed; the first key and row of each shard, one
    pair per shard, go to the tasks, so the texts move once. A key with more tokens than a shard
    fills several.
    """
    ranged = number_rows(rows.select("_key", "_row", "_n"), [], [F.col("_key"), F.col("_row")], sums=["_n"])
    shard = F.floor((F.col("_n_upto") - F.col("_n")) / shard_tokens).alias("_shard")
    firsts = ranged.groupBy(shard).agg(F.min(F.struct("_key", "_row")).alias("f")).select("f.*").collect()
    starts = sorted((f["_key"], f["_row"]) for f in firsts)

    @F.pandas_udf("long")
    def place(keys: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(starts, pair) - 1 for pair in zip(keys, at, strict=True)], dtype="int64")

    return rows.select("item_id", "_ids", "_row", place("_key", "_row").alias("_shard"))


class Bm25Shard:
    """An index of one shard: per token the distinct captions that hold it and their weights.

    Every token counts. Those in many of the shard's captions are columns of a dense matrix, at
    most 1 / COMMON numbers per posting; the others have posting lists.
    """

    def __init__(self, ids: list[np.ndarray], frequencies: np.ndarray, captions: int, mean_length: float):
        places: dict[bytes, int] = {}
        self.text = np.array([places.setdefault(i.tobytes(), len(places)) for i in ids])
        self.n = len(places)
        firsts = np.unique(self.text, return_index=True)[1]
        found = [np.unique(ids[i], return_counts=True) for i in firsts]
        terms = np.concatenate([t for t, _ in found])
        counts = np.concatenate([c for _, c in found]).astype(float)
        owners = np.repeat(np.arange(self.n), [len(t) for t, _ in found])
        lengths = np.array([len(ids[i]) for i in firsts], dtype=float)
        idf = np.log1p((captions - frequencies[terms] + 0.5) / (frequencies[terms] + 0.5))
        weights = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[owners] / mean_length))
        common = np.bincount(terms, minlength=len(frequencies)) > max(1.0, COMMON * self.n)
        column = np.cumsum(common) - 1
        self.dense = np.zeros((self.n, int(common.sum())))
        often = common[terms]
        self.dense[owners[often], column[terms[often]]] = weights[often]
        self.terms = [t[~common[t]] for t, _ in found]
        self.columns = [column[t[common[t]]] for t, _ in found]
        terms, owners, weights = terms[~often], owners[~often], weights[~often]
        order = np.argsort(terms, kind="stable")
        self.owners, self.weights = owners[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(frequencies) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all captions of the shard for the seed's terms."""
        text = self.text[seed]
        asked = np.zeros(self.dense.shape[1])
        asked[self.columns[text]] = 1.0
        out = self.dense @ asked
        first, last = self.starts[self.terms[text]], self.starts[self.terms[text] + 1]
        sizes = last - first
        if sizes.sum():
            at = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            out += np.bincount(self.owners[at], weights=self.weights[at], minlength=self.n)
        return out[self.text]


def pack_shard(ids: list[np.ndarray], index: Bm25Shard, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (caption, start, length, sequence, offset) of one shard.

    A caption first fills windows of its own. What is left of it is a seed, or a neighbour of
    one: a seed's window is filled with its best unused neighbours, and one that is too long
    gives its start and is the next seed. What is left at the end is cut at powers of two.
    """
    pieces, sequence = [], 0
    begin = np.zeros(len(ids), dtype=np.int64)
    left = np.array([len(i) for i in ids], dtype=np.int64)
    for c in np.nonzero(left >= window)[0]:
        for _ in range(left[c] // window):
            pieces.append((c, int(begin[c]), window, sequence, 0))
            begin[c] += window
            sequence += 1
        left[c] %= window
    waiting, following, seed = left > 0, iter(range(len(ids))), None
    while True:
        if seed is None:
            seed = next((c for c in following if waiting[c]), None)
            if seed is None:
                return pieces
        room, parts, chosen, scores = window, [], seed, None
        while chosen is not None:
            take = int(min(room, left[chosen]))
            parts.append((chosen, int(begin[chosen]), take))
            begin[chosen] += take
            left[chosen] -= take
            room -= take
            waiting[chosen] = left[chosen] > 0
            if not room:
                break
            if scores is None:
                scores = np.where(waiting, index.scores(seed), -1.0)
            scores[chosen] = -1.0
            best = int(scores.argmax())
            chosen = best if scores[best] >= 0 else None
        seed = chosen if room == 0 and left[chosen] else None
        if not room:
            pieces += [(c, s, n, sequence, window - sum(p[2] for p in parts[i:])) for i, (c, s, n) in enumerate(parts)]
            sequence += 1
        else:
            sequence = _cut(parts, window - room, sequence, pieces)


def _cut(parts: list[tuple[int, int, int]], total: int, sequence: int, pieces: list) -> int:
    """The last parts as sequences whose lengths are powers of two, the largest first."""
    for bit in reversed(range(total.bit_length())):
        size = total & (1 << bit)
        offset = 0
        while offset < size:
            c, start, n = parts[0]
            take = min(n, size - offset)
            pieces.append((c, start, take, sequence, offset))
            offset += take
            parts = [(c, start + take, n - take), *parts[1:]] if take < n else parts[1:]
        sequence += bool(size)
    return sequence


def pack_captions(captions: DataFrame, tokenizer: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all captions in sequences of at most `window` tokens: item_id, start, length,
    token_ids (binary, unsigned little-endian 32-bit), caption_tokens, sequence_id, offset.

    A caption is its tokens, by the byte-level BPE file `tokenizer`, and one end token. Captions
    are tokenised once, where they lie, and written to the shared folder with the number of
    captions each token is in. They are dealt to shards of about `shard_tokens` in order of
    their contents (`Dealer`, `dealt`), so copies and captions with like tokens meet, and a large
    group fills several shards; a task holds one shard. Its BM25 index weighs all tokens by
    their frequency in all captions and returns a seed's unused neighbours, which fill its window
    (`pack_shard`). Neighbours in other shards are not searched. Nothing is padded: full windows, and at a shard's end
    lengths that are powers of two. Equal scores go to the earlier row.

    A null caption is an empty one, of one token. Repeated rows are packed each. Null ids are
    handed on. An empty table gives no pieces; other columns are not read.
    """
    spark, vocabulary = captions.sparkSession, encoder(tokenizer).n_vocab
    table = stored(tokenised(captions, tokenizer).withColumn("_row", F.monotonically_increasing_id()))
    kind, rows = _narrow(encoder(tokenizer)), table.where("_ids IS NOT NULL")
    sums = rows.agg(F.count("*").alias("captions"), F.sum("_n").alias("tokens")).first()
    n, tokens = sums["captions"], sums["tokens"] or 0
    shards = max(1, math.ceil(tokens / shard_tokens))
    frequencies = spark.sparkContext.broadcast(document_frequencies(table, vocabulary))
    mean_length = tokens / max(1, n)
    schema = T.StructType([captions.select("item_id").schema["item_id"]])
    for name, kind_of in (("start", "long"), ("length", "long"), ("token_ids", "binary"), ("caption_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        schema = schema.add(name, kind_of)

    def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("_row", kind="stable")
        ids = [np.frombuffer(b, dtype=kind) for b in shard["_ids"]]
        index = Bm25Shard(ids, frequencies.value, n, mean_length)
        pieces = pack_shard(ids, index, window)
        at = [p[0] for p in pieces]
        return pd.DataFrame(
            {
                "item_id": shard["item_id"].iloc[at].to_numpy(),
                "start": [p[1] for p in pieces],
                "length": [p[2] for p in pieces],
                "token_ids": [ids[c][s : s + k].astype("<u4").tobytes() for c, s, k, _, _ in pieces],
                "caption_tokens": [len(ids[c]) for c in at],
                "sequence_id": [key[0] * SEQUENCE + p[3] for p in pieces],
                "offset": [p[4] for p in pieces],
            }
        )

    # as many tasks as shards, so that a task's share stays the same at any size
    shared = dealt(rows, shard_tokens).repartition(shards, "_shard")
    return shared.groupBy("_shard").applyInPandas(run, schema)
