"""Quality of captions by a small convolutional network over their bytes, in numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.scale import stored

# Bytes a filter sees, size of a byte's code, filters, hidden units.
WIDTH, CODE, FILTERS, HIDDEN = 5, 8, 24, 16
# Windows of a chunk; neighbouring chunks share WIDTH - 1 bytes, so that every window lies in one.
CHUNK = 256
# Stands for what follows the last byte of a text.
PAD = 256
# Windows worked on at a time.
PIECE = 256 * CHUNK
SHAPES = {"codes": (257, CODE), "filters": (WIDTH * CODE, FILTERS), "floor": (FILTERS,), "mix": (FILTERS, HIDDEN), "mix_floor": (HIDDEN,), "last": (HIDDEN,), "bias": (1,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
OWN = ("score", "predicted")


def unpacked(theta: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = theta[at : at + size].reshape(shape)
        at += size
    return out


def started(seed: int, prior: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    scale = {"codes": 0.5, "filters": (WIDTH * CODE) ** -0.5, "mix": (2 / FILTERS) ** 0.5, "last": HIDDEN**-0.5}
    parts = {k: rng.normal(0, scale[k], s) if k in scale else np.zeros(s) for k, s in SHAPES.items()}
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    parts["bias"][:] = np.log(prior / (1 - prior))
    return np.concatenate([p.ravel() for p in parts.values()])


def chunks_of(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte values, first window of each chunk) of a whole text, PIECE windows at a time; an empty text is one window of padding."""
    whole = np.full(max(len(text), 1) + WIDTH - 1, PAD, dtype=np.int16)
    whole[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    n = len(whole) - WIDTH + 1
    for low in range(0, n, PIECE):
        size = min(PIECE, n - low)
        yield whole[low : low + size + WIDTH - 1], np.arange(0, size, CHUNK)


def responses(net: dict[str, np.ndarray], values: np.ndarray) -> np.ndarray:
    """Filters at every window."""
    coded = net["codes"][values]
    n = len(values) - WIDTH + 1
    windows = np.lib.stride_tricks.as_strided(coded, (n, WIDTH * CODE), (coded.strides[0], coded.strides[1]), writeable=False)
    return np.ascontiguousarray(windows) @ net["filters"] + net["floor"]


def evidence(net: dict[str, np.ndarray], pooled: np.ndarray) -> np.ndarray:
    """What each chunk says about its text."""
    return np.maximum(np.maximum(pooled, 0) @ net["mix"] + net["mix_floor"], 0) @ net["last"]


def probability(net: dict[str, np.ndarray], text: bytes) -> float:
    total, n = 0.0, 0
    for values, first in chunks_of(text):
        found = evidence(net, np.maximum.reduceat(responses(net, values), first, axis=0))
        total, n = total + float(found.sum()), n + len(found)
    return float(1 / (1 + np.exp(-np.clip(total / n + float(net["bias"][0]), -40, 40))))


def gradient(theta: np.ndarray, text: bytes, label: int) -> tuple[np.ndarray, float]:
    """(gradient of the log loss, log loss) of one text; only the windows that won their chunk pass anything back."""
    net = unpacked(theta)
    pooled, seen = [], []
    for values, first in chunks_of(text):
        found = responses(net, values)
        last = np.minimum(first + CHUNK, len(found))
        best = np.stack([found[a:b].argmax(axis=0) + a for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        pooled.append(found[best, np.arange(FILTERS)])
        seen.append(values[best[:, :, None] + np.arange(WIDTH)])
    pooled, seen = np.concatenate(pooled), np.concatenate(seen)
    active = np.maximum(pooled, 0)
    inner = active @ net["mix"] + net["mix_floor"]
    hidden = np.maximum(inner, 0)
    z = float((hidden @ net["last"]).mean() + net["bias"][0])
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    slope = p - label
    out = {k: np.zeros(s) for k, s in SHAPES.items()}
    out["bias"][0] = slope
    out["last"] = slope * hidden.mean(axis=0)
    back = slope / len(pooled) * net["last"] * (inner > 0)
    out["mix"], out["mix_floor"] = active.T @ back, back.sum(axis=0)
    won = (back @ net["mix"].T) * (pooled > 0)
    out["floor"] = won.sum(axis=0)
    codes = net["codes"][seen]
    out["filters"] = np.einsum("cf,cfwd->wdf", won, codes).reshape(WIDTH * CODE, FILTERS)
    share = won[:, :, None, None] * net["filters"].reshape(WIDTH, CODE, FILTERS).transpose(2, 0, 1)
    flat = share.reshape(-1, CODE)
    out["codes"] = np.stack([np.bincount(seen.ravel(), weights=flat[:, d], minlength=257) for d in range(CODE)], axis=1)
    return np.concatenate([v.ravel() for v in out.values()]), float(np.logaddexp(0.0, -z if label else z))


@dataclass
class ByteNetwork:
    """Fitted weights, and the rows they were fitted on; without any row every score is 0.5."""

    theta: np.ndarray | None
    rows: int = 0

    def score(self, text: bytes) -> float:
        return 0.5 if self.theta is None else probability(unpacked(self.theta.astype(np.float32)), text)


def _step(sample: DataFrame, theta: np.ndarray, parts: int, turn: int, weights: tuple[float, float]) -> np.ndarray:
    """Mean weighted gradient over one part of the sample; a task hands on one row, however many texts it read."""
    small = theta.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1)
        for b in batches:
            for text, label in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
                total[:SIZE] += weights[label] * gradient(small, text.as_buffer().to_pybytes(), label)[0]
                total[SIZE] += weights[label]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    rows = sample.where(F.col("part") == turn % parts).select("caption", "quality").mapInArrow(run, "sums array<double>").collect()
    sums = np.sum([r["sums"] for r in rows], axis=0) if rows else np.zeros(SIZE + 1)
    return sums[:SIZE] / max(sums[SIZE], 1.0)


def fit_quality(
    captions: DataFrame, labels: DataFrame, fit_rows: int = 1600, steps: int = 72, parts: int = 8, rate: float = 0.03, seed: int = 7
) -> ByteNetwork:
    """A network for `labels` (item_id, quality) of `captions` (item_id, caption), fitted by Adam.

    Fitted on a sample of at most `fit_rows` labelled rows, those first by a hash of (seed,
    item_id); their texts stay on the executors, cut into `parts` of the hash, and are read whole. A
    step sends the weights to the tasks and brings back one sum of gradients each, about 3,500
    numbers. Both labels weigh alike. Labels other than 0 and 1, null ids and ids without a
    caption are not fitted on; several labels of an id count one each.
    """
    known = labels.where("quality IN (0, 1) AND item_id IS NOT NULL").select("item_id", F.col("quality").cast("int").alias("quality"))
    known = known.join(captions.where("caption IS NOT NULL").select("item_id").distinct(), "item_id", "left_semi")
    drawn = known.withColumn("_h", F.xxhash64(F.lit(seed), "item_id")).orderBy("_h", "item_id", "quality").limit(fit_rows)
    # at most fit_rows rows of three numbers
    texts = captions.select("item_id", F.coalesce("caption", F.lit("")).alias("caption")).join(F.broadcast(drawn), "item_id")
    split = texts.withColumn("part", F.pmod("_h", F.lit(parts)).cast("int")).select("caption", "quality", "part")
    sample = stored(split.repartition(parts, "part", F.xxhash64("caption")))
    found = {r["quality"]: r["n"] for r in sample.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rows = sum(found.values())
    if not rows:
        return ByteNetwork(None)
    weights = tuple(rows / (2 * found[q]) if q in found else 0.0 for q in (0, 1))
    theta = started(seed, 0.5 if len(found) == 2 else float(max(found)))
    first, second = np.zeros(SIZE), np.zeros(SIZE)
    for turn in range(1, steps + 1):
        g = _step(sample, theta, parts, turn, weights)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        now = rate * (0.05 + 0.475 * (1 + np.cos(np.pi * (turn - 1) / steps)))
        theta = theta - now * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return ByteNetwork(theta, rows)


def score_quality(captions: DataFrame, network: ByteNetwork) -> DataFrame:
    """All input columns plus score (0 to 1, higher: quality 1 is likelier) and predicted (1 from 0.5 on).

    The whole `caption` is read as bytes in chunks of CHUNK windows that overlap by WIDTH - 1 bytes. Each
    byte has a learned code, learned filters look at WIDTH bytes, the strongest answer of a filter in a
    chunk counts, a hidden layer turns a chunk's answers into evidence, and the mean over all
    chunks becomes one probability. Every row is scored where it lies and nothing but its caption
    is read, so equal captions get equal scores. Null and empty captions are one window of
    padding; with nothing fitted all scores are 0.5. An empty table gives an empty table, and input
    columns named like a result are replaced.
    """
    read = captions.drop(*OWN)
    at = read.columns.index("caption")
    sent = captions.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array([sent.value.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(at)], dtype=float)
            new = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *OWN])

    return read.mapInArrow(run, T.StructType([*read.schema.fields]).add("score", "double").add("predicted", "integer"))
