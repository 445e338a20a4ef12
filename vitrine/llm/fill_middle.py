"""Fill-in-the-middle form of captions on a piece table: descriptors over buffers that never change."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Sentinels before prefix, suffix and middle, and the forms of an output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Order of the parts (0 prefix, 1 middle, 2 suffix) in each form, and the sentinel before each.
ORDER = {PSM: ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), SPM: ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}
# Outputs of a task handed on at a time.
FLUSH_BYTES = 16 << 20
ADDED = T.StructType().add("fim_text", "string").add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("fim_sha256", "string")
RESTORED = T.StructType().add("restored", "string").add("restored_sha256", "string")

LETTER = np.zeros(256, dtype=bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True


@dataclass
class PieceTable:
    """Descriptors (buffer, start, length) in reading order; cutting and arranging never copy text."""

    buffers: list[memoryview]
    pieces: list[tuple[int, int, int]] = field(default_factory=list)

    @staticmethod
    def of(text: bytes, *others: bytes) -> "PieceTable":
        buffers = [memoryview(b) for b in (text, *others)]
        return PieceTable(buffers, [(0, 0, len(text))])

    def cut(self, at: int) -> None:
        """Split the descriptor that holds byte `at` of the reading order; at an end it leaves an empty one."""
        for i, (buffer, start, length) in enumerate(self.pieces):
            if at <= length:
                self.pieces[i : i + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return
            at -= length
        raise IndexError("cut beyond the text")

    def arrange(self, order: list[tuple[int, int | None]]) -> "PieceTable":
        """Descriptors by number, each after the whole of a buffer if one is named."""
        out = []
        for piece, before in order:
            if before is not None:
                out.append((before, 0, len(self.buffers[before])))
            out.append(self.pieces[piece])
        return PieceTable(self.buffers, out)

    def spans(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for span in self.spans():
            digest.update(span)
        return digest.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.spans())


def unit_starts(text: bytes) -> np.ndarray:
    """Byte offsets of the units: runs of ASCII letters and single other characters."""
    b = np.frombuffer(text, dtype=np.uint8)
    letter = LETTER[b]
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] = False
    return np.nonzero(~inner & ((b & 0xC0) != 0x80))[0]


def chars(text: bytes | memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))


def draws(item_id, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if item_id is None else item_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: bytes, item_id, seed: int, rate: int, spm_rate: int) -> tuple[PieceTable, int, str, int | None, int | None]:
    """The output's piece table, the number of units, the form, and the characters of prefix and middle."""
    starts = unit_starts(text)
    n = len(starts)
    h = draws(item_id, seed)
    table = PieceTable.of(text, PREFIX, SUFFIX, MIDDLE)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return table, n, PLAIN, None, None
    form = SPM if h[3] % 100 < spm_rate else PSM
    low, high = (int(starts[u]) if u < n else len(text) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    table.cut(high)
    table.cut(low)
    number = {PREFIX: 1, SUFFIX: 2, MIDDLE: 3}
    prefix, middle, _ = (chars(s) for s in table.spans())
    return table.arrange([(part, number[sentinel]) for part, sentinel in ORDER[form]]), n, form, prefix, middle


def taken_back(output: bytes, form: str) -> PieceTable:
    """Piece table of the original text over the buffer of an output: its parts found by their sentinels, put back in order."""
    table = PieceTable.of(output)
    if form == PLAIN:
        return table
    order = ORDER[form]
    at, first = [], 0
    for _, sentinel in order:
        first = output.index(sentinel, first)
        at.append(first)
        first += len(sentinel)
    # sentinel, part, sentinel, part, ...
    for place, (_, sentinel) in zip(reversed(at), reversed(order), strict=True):
        table.cut(place + len(sentinel))
        table.cut(place)
    inverse = sorted(range(3), key=lambda i: order[i][0])
    return table.arrange([(2 + 2 * i, None) for i in inverse])


def _rows(df: DataFrame, added: T.StructType, make: Callable[..., list[tuple]], reads: list[str]) -> DataFrame:
    """All columns and the `added` ones, made row by row where the rows lie; long outputs leave in several batches."""
    read = df.drop(*added.names)
    at = [read.columns.index(c) for c in reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch, low, rows):
            part = batch.slice(low, len(rows))
            columns = [pa.array([r[i] for r in rows], KINDS[f.dataType.typeName()]) for i, f in enumerate(added.fields)]
            columns = [c.cast(pa.string()) if pa.types.is_binary(c.type) else c for c in columns]
            return pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*batch.schema.names, *added.names])

        for batch in batches:
            rows, size, low = [], 0, 0
            for i in range(batch.num_rows):
                values = [batch.column(c)[i] for c in at]
                rows.append(make(*values))
                size += len(rows[-1][0] or b"")
                if size > FLUSH_BYTES:
                    yield out(batch, low, rows)
                    rows, size, low = [], 0, i + 1
            if rows:
                yield out(batch, low, rows)

    return read.mapInArrow(run, T.StructType([*read.schema.fields, *added.fields]))


# Text leaves as the bytes it was made of.
KINDS = {"string": pa.binary(), "long": pa.int64()}


def _bytes(value: pa.Scalar) -> bytes:
    if not value.is_valid:
        return b""
    return value.as_buffer().to_pybytes()


def fill_in_middle(captions: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """All columns plus fim_text, n, form, prefix_chars, middle_chars, fim_sha256: captions as infilling examples.

    A whole `caption` has n units, runs of A-Z and a-z and single other characters. Four numbers
    from the SHA-256 of `seed`:`item_id` choose two cuts between units and the form: of 100 captions
    `rate` are cut, and of 100 of these `spm_rate` are arranged suffix first (`spm`), the others
    prefix first (`psm`); every part follows its sentinel. The rest, empty captions and those that
    hold a sentinel stay `plain`, without prefix_chars and middle_chars (in characters).

    A caption becomes a descriptor over its own bytes: a cut splits descriptors, a form permutes
    them between those of the sentinels, and fim_sha256 is taken over the descriptors in turn; text
    is copied once, to leave the task. Every row is worked on where it lies, so neither skew nor
    repeated rows matter. A null caption is an empty one, a null id counts as no digits. An empty
    table gives an empty table, and input columns named like a result are replaced.
    """

    def make(item_id: pa.Scalar, caption: pa.Scalar) -> tuple:
        table, n, form, prefix, middle = arranged(_bytes(caption), item_id.as_py(), seed, rate, spm_rate)
        return table.text(), n, form.encode(), prefix, middle, table.sha256().encode()

    return _rows(captions, ADDED, make, ["item_id", "caption"])


def restore_middle(examples: DataFrame) -> DataFrame:
    """All columns plus restored and restored_sha256: the captions rebuilt from fim_text and form alone.

    The parts are found by their sentinels and their descriptors put back in order; the digest is
    taken over these. A null fim_text is empty; a null form is `plain`. Input columns named like a
    result are replaced.
    """

    def make(output: pa.Scalar, form: pa.Scalar) -> tuple:
        table = taken_back(_bytes(output), form.as_py() or PLAIN)
        return table.text(), table.sha256().encode()

    return _rows(examples, RESTORED, make, ["fim_text", "form"])
