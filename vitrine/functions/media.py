"""Facts about file contents."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.scale import is_small


def _jpeg_size(b: bytes):
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            return None
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        at += 2 + (0 if 0xD0 <= marker <= 0xD9 else struct.unpack(">H", b[at + 2 : at + 4])[0])
    return None


def _webp_size(b: bytes):
    kind = b[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def image_size(b: bytes | None):
    """(width, height) from the header of a PNG, GIF, JPEG or WebP file, else None."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", b[16:24])
        if b[:4] == b"GIF8":
            return struct.unpack("<HH", b[6:10])
        if b[:2] == b"\xff\xd8":
            return _jpeg_size(b)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp_size(b)
    except (TypeError, struct.error, IndexError):
        pass
    return None


def header_size(content: Column) -> Column:
    """(width, height) struct."""

    @F.pandas_udf("width int, height int")
    def sizes(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in contents:
            found = [image_size(b) or (None, None) for b in batch]
            yield pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    return sizes(content)


def content_facts(df: DataFrame, content: str = "content") -> DataFrame:
    """Fill sha256, file_size, width and height where missing; `unreadable` marks sizes not found.

    Any of the four columns may be absent from `df`.
    """
    size = df.withColumn("_s", header_size(F.col(content)))
    found = {
        "sha256": F.sha2(F.col(content), 256),
        "file_size": F.length(content).cast("long"),
        "width": F.col("_s.width"),
        "height": F.col("_s.height"),
    }
    filled = size.withColumns({c: F.coalesce(c, v) if c in df.columns else v for c, v in found.items()})
    return filled.withColumn("unreadable", F.col("width").isNull()).drop("_s")


def hash_cache(paths: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """path, sha256, cached: known hashes are reused, only the other contents are read.

    Contents are hashed where they are read, so only hashes are shuffled.
    """
    known = paths.join(cache.select("path", "sha256"), "path").withColumn("cached", F.lit(True))
    rest = paths.join(cache.select("path"), "path", "left_anti")
    source = files.join(F.broadcast(rest.select("path")), "path", "left_semi") if is_small(rest) else files
    hashed = source.select("path", F.sha2(F.col("content"), 256).alias("sha256"))
    fresh = rest.join(hashed, "path", "left").withColumn("cached", F.lit(False))
    return known.select("path", "sha256", "cached").unionByName(fresh)
