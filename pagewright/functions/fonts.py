"""Advance widths of a font's characters, read from the tables of a TrueType or OpenType file."""

from __future__ import annotations

import functools
import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODES = 0x110000
DEFAULT_FONT = "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf"
#: Widths in hundredths of the size where there is no font file: characters of one width each.
PLAIN_WIDTHS = {25: " !'(),./:;I[]fijlrt|", 85: "%@MWmw—"}
PLAIN_OTHERS = 55


@dataclass(frozen=True)
class Metrics:
    """Advance widths by character in units of the em; characters without one have that of `missing`."""

    units: int
    missing: int
    advances: dict[int, int]

    def table(self) -> np.ndarray:
        """Advances by code point."""
        out = np.full(CODES, self.missing, np.int32)
        out[np.fromiter(self.advances, np.int64, len(self.advances))] = np.fromiter(self.advances.values(), np.int64, len(self.advances))
        return out


def _characters(data: bytes, at: int) -> dict[int, int]:
    """Glyphs by code point from a character map that starts at `at`."""
    count = struct.unpack_from(">H", data, at + 2)[0]
    maps = [struct.unpack_from(">HHI", data, at + 4 + 8 * i) for i in range(count)]
    best: dict[int, int] = {}
    for platform, kind, offset in maps:
        if platform not in (0, 3) or platform == 3 and kind not in (1, 10):
            continue
        start = at + offset
        layout = struct.unpack_from(">H", data, start)[0]
        found: dict[int, int] = {}
        if layout == 12:
            for i in range(struct.unpack_from(">I", data, start + 12)[0]):
                first, last, glyph = struct.unpack_from(">III", data, start + 16 + 12 * i)
                found |= zip(range(first, last + 1), range(glyph, glyph + last - first + 1))
        elif layout == 4:
            n = struct.unpack_from(">H", data, start + 6)[0] // 2
            rows = [np.frombuffer(data, ">u2", n, start + 14 + 2 * n * i + (2 if i else 0)).astype(int) for i in range(4)]
            base = start + 16 + 6 * n  # of the offsets into the glyph list, each counted from its own place
            for i, (last, first, shift, jump) in enumerate(zip(*rows)):
                for code in range(first, last + 1):
                    glyph = code + shift
                    if jump:
                        glyph = struct.unpack_from(">H", data, base + 2 * i + jump + 2 * (code - first))[0]
                        glyph += shift if glyph else 0
                    if code != 0xFFFF and glyph & 0xFFFF:
                        found[code] = int(glyph & 0xFFFF)
        if len(found) > len(best):
            best = found
    return best


def parsed(data: bytes) -> Metrics:
    """Metrics of a font file; a ValueError if it is none."""
    if data[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
        raise ValueError("not a TrueType or OpenType font")
    tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">I", data, 20 + 16 * i)[0] for i in range(struct.unpack_from(">H", data, 4)[0])}
    if missing := {b"head", b"hhea", b"hmtx", b"cmap"} - tables.keys():
        raise ValueError(f"a font without {sorted(missing)}")
    units = struct.unpack_from(">H", data, tables[b"head"] + 18)[0]
    full = struct.unpack_from(">H", data, tables[b"hhea"] + 34)[0]
    wide = np.frombuffer(data, ">u2", 2 * full, tables[b"hmtx"])[::2].astype(int)
    # glyphs behind the last full entry have its width
    return Metrics(units, int(wide[0]), {code: int(wide[min(glyph, full - 1)]) for code, glyph in _characters(data, tables[b"cmap"]).items()})


def plain_metrics() -> Metrics:
    return Metrics(100, PLAIN_OTHERS, {ord(c): w for w, chars in PLAIN_WIDTHS.items() for c in chars})


@functools.lru_cache(maxsize=4)
def metrics(path: str | None = DEFAULT_FONT) -> Metrics:
    """Metrics of the font at a path of this machine, or the plain ones if there is none."""
    if not path or not os.path.exists(path):
        return plain_metrics()
    with open(path, "rb") as f:
        return parsed(f.read())


def glyph_advances(spark: SparkSession, path: str) -> DataFrame:
    """(path, units, missing, advances) for each font file below a path that Spark can read; advances: a map by code point."""
    kind = T.StructType.fromDDL("units int, missing int, advances map<int,int>")

    @F.udf(kind)
    def read(content):
        found = parsed(bytes(content))
        return found.units, found.missing, found.advances

    return spark.read.format("binaryFile").load(path).select("path", read("content").alias("m")).select("path", "m.*")
