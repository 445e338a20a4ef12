"""Token counts of captions: Viterbi over a unigram vocabulary that keeps only scores and counts."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
# An unknown character scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0
# Words a worker remembers; more are counted again.
REMEMBERED = 800_000


class UnigramCounter:
    """Counts the pieces of the best segmentation under (piece, score).

    The rules are those of unigram tokenizers: the sum of scores is largest; of equal sums the one
    whose last piece starts earlier wins, at every position; a character that is no piece itself
    may be unknown, for the worst score less a penalty. Unknown text counts its bytes if the
    vocabulary has pieces for bytes, else one for each run. Text gets a space in front unless it
    starts with one, and spaces are `▁`.
    """

    def __init__(self, pieces: Iterable[tuple[str, float]], bytes_fall_back: bool):
        scores = dict(pieces)
        self.bytes_fall_back = bytes_fall_back
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.singles = {p for p in scores if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), float(s)))
        if scores:
            self.automaton.make_automaton()
        # Where no piece reaches over a gap, the sides are independent; so are sums of whole numbers.
        whole = all(float(s).is_integer() for s in scores.values())
        gaps = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores) and not any("\n" in p for p in scores)
        self.cut = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+") if whole and gaps and bytes_fall_back else None
        self.known: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Pieces of the best path through `text`."""
        found: list[list[tuple[int, float]]] = [[] for _ in text]
        if len(self.automaton):
            # matches with one end come longest first, so the earliest start is met first
            for end, match in self.automaton.iter(text):
                found[end].append(match)
        score, count, run = [0.0] * (len(text) + 1), [0] * (len(text) + 1), [False] * (len(text) + 1)
        for end, char in enumerate(text, 1):
            best, pieces, unknown = None, 0, False
            for length, s in found[end - 1]:
                sum_ = score[end - length] + s
                if best is None or sum_ > best:
                    best, pieces = sum_, count[end - length] + 1
            if char not in self.singles:
                sum_ = score[end - 1] + self.unknown
                if best is None or sum_ > best:
                    best, unknown = sum_, True
                    new = len(char.encode("utf-8", "replace")) if self.bytes_fall_back else int(not run[end - 1])
                    pieces = count[end - 1] + new
            score[end], count[end], run[end] = best, pieces, unknown
        return count[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        text = text if text[0] == SPACE else SPACE + text
        if self.cut is None:
            return self.segment(text)
        words = self.cut.findall(text)
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            fresh = {w: self.segment(w) for w in set(words).difference(self.known)}
        if len(self.known) + len(fresh) > REMEMBERED:
            kept = {w: self.known[w] for w in set(words).intersection(self.known)}
            total = sum(map((kept | fresh).__getitem__, words))
            self.known = {}
            return total
        self.known.update(fresh)
        return sum(map(self.known.__getitem__, words))


@functools.lru_cache(maxsize=4)
def counter(path: str) -> UnigramCounter:
    """The pieces of a model file and their scores; control and byte pieces are not matched in texts."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in plain], any(map(model.is_byte, ids)))


def count_tokens(captions: DataFrame, vocabulary: str) -> DataFrame:
    """All input columns plus n_tokens: the tokens of each whole caption under the unigram vocabulary
    file `vocabulary`, as the project's usage log counts prompts and completions.

    An Aho-Corasick automaton of the pieces gives all matches in one pass over a word; the
    dynamic program keeps best score and piece count per position and nothing to trace back.
    Words are counted where they lie, each once per worker as far as REMEMBERED goes; there is no
    shuffle.

    Null and empty captions count 0. Repeated rows are counted each; a column n_tokens is replaced.
    """
    read = captions.drop("n_tokens")
    at = read.columns.index("caption")
    schema = T.StructType([*read.schema.fields]).add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for b in batches:
            new = pa.array([tokens.count(t.as_py()) for t in b.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=schema.names)

    return read.mapInArrow(run, schema)
