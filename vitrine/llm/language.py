"""Language of captions by error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
# Hash buckets of byte trigrams.
BUCKETS = 1 << 16
SMOOTHING = 0.5
# How sharply losses become a score.
SHARPNESS = 4.0
# Below this score the two nearest codewords are too close to tell.
AMBIGUOUS = 0.4
MAX_LANGUAGES = 512
# Grams gathered at a time, and the most for which gathering is used at all.
LONG = 1 << 15
OWN = ("lang_pred", "score", "second", "ambiguous")


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the whole lower-cased text, a space added at both ends."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to five classes, else the most distant of random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        columns = [[1] + [1 if k >> (n - 2 - i) & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, dtype=float).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    width = math.ceil(10 * math.log2(n))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        for column in code.T[abs(code.sum(axis=0)) == n]:
            column[rng.integers(n)] *= -1
        distance = (width - code @ code.T) / 2 + width * np.eye(n)
        if distance.min() > apart:
            best, apart = code, distance.min()
    return best


@dataclass
class LanguageModel:
    """`languages` in order of name; `weights` (bucket, bit); `code` and `trust` (language, bit)."""

    languages: list[str]
    weights: np.ndarray
    code: np.ndarray
    trust: np.ndarray

    def margins(self, buckets: np.ndarray) -> np.ndarray:
        """Mean log odds of each bit over the n-grams."""
        if len(buckets) > LONG:
            return np.bincount(buckets, minlength=BUCKETS) @ self.weights / len(buckets)
        return self.weights[buckets].mean(axis=0)

    def decide(self, text: str | None) -> tuple[str, float, str | None, bool]:
        """Nearest codeword's language, its score, the runner-up, and whether the two are too near."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, None, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, None, False
        agree = np.clip(self.code * self.margins(grams(text)), -6, 6)
        loss = (self.trust * np.exp(-agree)).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        likely = np.exp(-SHARPNESS * (loss - loss[order[0]]))
        score = float(1 / likely.sum())
        return self.languages[order[0]], score, self.languages[order[1]], score < AMBIGUOUS


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n over the whole texts of all labelled captions; summed per task before the shuffle."""
    read = labelled.where("lang IS NOT NULL AND caption IS NOT NULL").select("lang", "caption")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    found = np.bincount(grams(text), minlength=BUCKETS)
                    sums[lang] = found if lang not in sums else sums[lang] + found
        for lang, n in sums.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"]
            )

    return read.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(labelled: DataFrame) -> LanguageModel:
    """One n-gram classifier per bit of the languages' codewords, from captions with a `lang`.

    Counts cover every labelled row. A bit's classifier holds, for each n-gram, the log odds of
    the languages whose codeword has the bit against the rest, languages counting alike. `trust`
    weighs a bit for a language by how well it tells that language's own n-grams apart. Only the
    counts reach the driver: BUCKETS numbers per language, of MAX_LANGUAGES at most, else an error.
    """
    counts = gram_counts(labelled)
    names = [r["lang"] for r in labelled.where("lang IS NOT NULL AND caption IS NOT NULL").select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = counts.toPandas()
    languages = sorted(rows["lang"].unique())
    table = np.zeros((len(languages), BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    table[rows["lang"].map(place).to_numpy(dtype=int), rows["bucket"].to_numpy(dtype=int)] = rows["n"].to_numpy(dtype=float)
    return model_of(languages, table)


def model_of(languages: list[str], table: np.ndarray) -> LanguageModel:
    share = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    code = codewords(len(languages))
    if code.shape[1] == 0:
        return LanguageModel(languages, np.zeros((BUCKETS, 0)), code, np.ones(code.shape))
    side = lambda sign: (share.T @ (code == sign)) / (code == sign).sum(axis=0)
    weights = np.log(side(1)) - np.log(side(-1))
    expected = np.maximum(code * (share @ weights), 1e-6)
    # a bit's weakest language gets margin one
    scale = expected.min(axis=0)
    trust = expected / scale
    return LanguageModel(languages, weights / scale, code, trust / trust.sum(axis=1, keepdims=True))


def detect_language(captions: DataFrame, model: LanguageModel) -> DataFrame:
    """All input columns plus lang_pred, score (0 to 1), second, ambiguous.

    The whole `caption` is scored by every bit's classifier where it lies, without a shuffle; the
    language is that of the codeword with the smallest loss over the bits, weighted by how far
    each is trusted, and the score says how far the others are. `ambiguous` marks scores below
    AMBIGUOUS; `second` is the runner-up. Equal losses go to the first language by name.

    Captions without a letter (null, blank, numbers) are `und` with score 0 and ambiguous. With
    no language learned all are; with one, all others are that one. Nothing but the caption is
    read; input columns named like a result are replaced. The project stores captions and post
    texts without their language, so labels come from the caller.
    """
    read = captions.drop(*OWN)
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("second", "string").add("ambiguous", "boolean")
    at = read.columns.index("caption")
    sent = captions.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.decide(t.as_py()) for t in b.column(at)]
            kinds = (pa.string(), pa.float64(), pa.string(), pa.bool_())
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *added.names])

    return read.mapInArrow(run, T.StructType([*read.schema.fields, *added.fields]))
