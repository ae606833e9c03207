"""Raster images in Arrow batches: PNG files to arrays of samples, and how much of a line's width its ink takes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_MARK = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by kind of colour
# Least opacity and contrast, distance of ink from the mean, share of a column's height, least ratio, and the ratio that counts as all.
OPAQUE, CONTRAST, DISTANCE, COLUMN_SHARE, LEAST_RATIO, FULL_RATIO = 24, 18, 30, 0.18, 0.2, 0.97
LINE_PAD = 0.04  # of a line's height, above and below


#: Rows in a row that need the pixel to their left, from which on diagonals are worth it.
_FEW = 8


def _unfiltered(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows (height, bytes) whose filters are undone, row by row; runs of rows with the filters that mix neighbours together."""
    if not kinds.any():
        return rows
    high, wide = rows.shape[0], rows.shape[1] // step
    px = np.zeros((high + 1, wide + 1, step), np.int16)
    px[1:, 1:] = rows.reshape(high, wide, step)
    r = 0
    while r < high:
        if kinds[r] == 1:
            px[r + 1, 1:] = np.cumsum(px[r + 1, 1:], axis=0, dtype=np.int64) & 255
        elif kinds[r] == 2:
            px[r + 1] = (px[r + 1] + px[r]) & 255
        elif kinds[r]:
            end = r + 1
            while end < high and kinds[end] > 2:
                end += 1
            if end - r < _FEW:
                for k in range(r, end):
                    px[k + 1] = _mixed(px[k].tolist(), px[k + 1].tolist(), int(kinds[k]))
            else:
                _diagonals(px, kinds, r, end)
            r = end - 1
        r += 1
    return px[1:, 1:].reshape(high, wide * step).astype(np.uint8)


def _unfiltered_plain(rows: np.ndarray, kinds: np.ndarray, starts: np.ndarray, step: int) -> np.ndarray:
    """The same for rows of many images, one below the other, with the filters that mix no neighbours; starts: whether a row is an image's first."""
    out = rows.copy()
    left = np.flatnonzero(kinds == 1)
    if len(left):
        # one pixel after the other in all rows; bytes wrap around
        unit = np.uint32 if step == 4 else np.uint8  # what is moved together
        turned = lambda x: np.ascontiguousarray(x.transpose(1, 0, 2))
        own = turned(out[left].view(unit).reshape(len(left), out.shape[1] // step, -1))
        px = own.reshape(len(own), -1).view(np.uint8)
        for i in range(1, len(px)):
            px[i] += px[i - 1]
        out[left] = turned(own).reshape(len(left), -1).view(np.uint8)
    up = (kinds == 2) & ~starts
    depth = np.arange(len(out)) - np.maximum.accumulate(np.where(up, 0, np.arange(len(out))))  # rows in a row that need the one above
    by_depth = np.argsort(depth, kind="stable")
    ends = np.cumsum(np.bincount(depth, minlength=1))
    for first, end in zip(ends[:-1], ends[1:]):
        at = by_depth[first:end]
        out[at] += out[at - 1]
    return out


def _nearest(left, up, corner):
    """Whichever of the three is nearest to the plane through them, the first on ties."""
    to = left + up - corner
    a, b, e = abs(to - left), abs(to - up), abs(to - corner)
    return np.where((a <= b) & (a <= e), left, np.where(b <= e, up, corner))


def _mixed(above: list, row: list, kind: int) -> list:
    for i in range(1, len(row)):
        for k, (left, up, corner) in enumerate(zip(row[i - 1], above[i], above[i - 1])):
            if kind == 3:
                near = (left + up) >> 1
            else:
                a, b, e = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                near = left if a <= b and a <= e else up if b <= e else corner
            row[i][k] = (row[i][k] + near) & 255
    return row


def _diagonals(px: np.ndarray, kinds: np.ndarray, first: int, end: int) -> None:
    """The same for rows first to end: all pixels of a diagonal have their neighbours on earlier ones."""
    high, wide = end - first, px.shape[1] - 1
    for d in range(high + wide - 1):
        r = np.arange(max(0, d - wide + 1), min(high, d + 1))
        c, r = d - r, r + first
        left, up, corner = px[r + 1, c], px[r, c + 1], px[r, c]
        near = np.where(kinds[r][:, None] == 3, (left + up) >> 1, _nearest(left, up, corner))
        px[r + 1, c + 1] = (px[r + 1, c + 1] + near) & 255


class _File(NamedTuple):
    """What a PNG file holds; rows as they are filtered, with the kind of filter before each."""

    wide: int
    high: int
    depth: int
    colour: int
    palette: np.ndarray
    clear: bytes
    flat: np.ndarray

    @property
    def step(self) -> int:
        return max(1, _SAMPLES[self.colour] * self.depth // 8)


def _parsed(data: bytes) -> _File:
    if not data.startswith(_MARK):
        raise ValueError("not a PNG file")
    at, packed, palette, clear = len(_MARK), [], np.zeros((256, 3), np.uint8), b""
    wide = high = depth = colour = None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            wide, high, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if interlaced:
                raise ValueError("an interlaced image")
        elif kind == b"PLTE":
            palette[: size // 3] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if wide is None or colour not in _SAMPLES:
        raise ValueError("a PNG file without a header")
    samples = _SAMPLES[colour]
    width = -(-wide * samples * depth // 8)
    flat = np.frombuffer(zlib.decompress(b"".join(packed), bufsize=max(1, high * (width + 1))), np.uint8)[: high * (width + 1)].reshape(high, width + 1)
    return _File(wide, high, depth, colour, palette, clear, flat)


def _pixels(f: _File, rows: np.ndarray) -> np.ndarray:
    wide, high, depth, colour, palette, clear = f[:6]
    samples = _SAMPLES[colour]
    if (colour, depth) == (6, 8):
        return rows.reshape(high, wide, 4)
    if depth == 16:
        values = rows.reshape(high, -1, 2)[:, :, 0]  # the higher byte
    elif depth < 8:
        values = np.unpackbits(rows, axis=1).reshape(high, -1, depth) @ (1 << np.arange(depth)[::-1])
        values = (values if colour == 3 else values * 255 // ((1 << depth) - 1)).astype(np.uint8)
    else:
        values = rows
    px = values[:, : wide * samples].reshape(high, wide, samples)
    out = np.full((high, wide, 4), 255, np.uint8)
    if colour == 3:
        out[:, :, :3] = palette[px[:, :, 0]]
        opacity = np.full(256, 255, np.uint8)
        opacity[: len(clear)] = np.frombuffer(clear, np.uint8)
        out[:, :, 3] = opacity[px[:, :, 0]]
        return out
    out[:, :, :3] = px[:, :, : 3 if samples > 2 else 1]
    if samples in (2, 4):
        out[:, :, 3] = px[:, :, -1]
    elif clear:
        key = np.frombuffer(clear, ">u2") >> (8 if depth == 16 else 0)
        key = key if depth >= 8 else key * 255 // ((1 << depth) - 1)
        out[(px == key).all(axis=2), 3] = 0
    return out


def decoded(data: bytes) -> np.ndarray:
    """(height, width, 4) samples of red, green, blue and opacity of a PNG file; a ValueError if it is none or interlaced."""
    f = _parsed(data)
    return _pixels(f, _unfiltered(f.flat[:, 1:], f.flat[:, 0], f.step))


def _decoded_together(files: list[_File]) -> list[np.ndarray]:
    """Samples of many files; those of one width of rows and without filters that mix neighbours are unfiltered together."""
    out: list[np.ndarray | None] = [None] * len(files)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(files):
        if f.high and f.flat[:, 0].max() <= 2:
            alike.setdefault((f.flat.shape[1], f.step), []).append(i)
        else:
            out[i] = _pixels(f, _unfiltered(f.flat[:, 1:], f.flat[:, 0], f.step))
    for (_, step), members in alike.items():
        flat = np.concatenate([files[i].flat for i in members])
        ends = np.cumsum([files[i].high for i in members])
        starts = np.zeros(len(flat), bool)
        starts[[0, *ends[:-1]]] = True
        rows = _unfiltered_plain(flat[:, 1:], flat[:, 0], starts, step)
        for i, end in zip(members, ends):
            out[i] = _pixels(files[i], rows[end - files[i].high : end])
    return out


def encoded_together(px: np.ndarray, sizes: list[int], kinds: np.ndarray) -> list[bytes]:
    """PNG files of images that are one below the other in (rows, width, 4) samples; sizes: their heights, kinds: the filter of each row."""
    wide = px.shape[1]
    rows, kinds = px.reshape(len(px), wide * 4), kinds.astype(np.uint8)
    ends = np.cumsum(sizes)
    starts = np.zeros(len(rows) + 1, bool)
    starts[[0, *ends]] = True
    flat = np.empty((len(rows), wide * 4 + 1), np.uint8)
    flat[:, 0], flat[:, 1:] = kinds, rows
    for kind in set(np.unique(kinds).tolist()) - {0}:
        at = np.flatnonzero(kinds == kind)
        if kind <= 2:  # these wrap around as bytes
            own = rows[at]
            if kind == 1:
                own[:, 4:] -= rows[at, :-4]
            else:
                own -= np.where(starts[at][:, None], np.uint8(0), rows[at - 1])
            flat[at, 1:] = own
            continue
        own = rows[at].astype(np.int16)
        up = np.where(starts[at][:, None], 0, rows[at - 1]).astype(np.int16)
        left, corner = np.zeros_like(own), np.zeros_like(own)
        left[:, 4:], corner[:, 4:] = own[:, :-4], up[:, :-4]
        flat[at, 1:] = (own - ((left + up) >> 1 if kind == 3 else _nearest(left, up, corner))) & 255
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = lambda high: chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 6, 0, 0, 0))
    return [_MARK + head(high) + chunk(b"IDAT", zlib.compress(flat[end - high : end].tobytes(), 1)) + chunk(b"IEND", b"") for high, end in zip(sizes, ends)]


def encoded(px: np.ndarray, kinds: np.ndarray | None = None) -> bytes:
    """A PNG file of (height, width, 4) samples; kinds: the filter of each row, none where it is not given."""
    return encoded_together(px, [len(px)], np.zeros(len(px), np.uint8) if kinds is None else kinds)[0]


def _light(px: np.ndarray) -> np.ndarray:
    return px[:, :, 0] * 0.299 + px[:, :, 1] * 0.587 + px[:, :, 2] * 0.114



#: Bytes of images that are read and measured together.
TOGETHER = 2 << 20


def _alike(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one width, one below the other: for each row the run of equal rows that it is in, where runs begin and end, light and opacity of each run."""
    px = images[0] if len(images) == 1 else np.concatenate(images)
    whole = np.ascontiguousarray(px).view(np.uint32)[:, :, 0]
    new = np.ones(len(px), bool)
    new[1:] = (whole[1:] != whole[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return np.cumsum(new) - 1, np.append(at, len(px)), _light(px[at]), px[at, :, 3] >= OPAQUE


def _ratios(images: list[np.ndarray], of: np.ndarray, first: np.ndarray, rows: np.ndarray, left: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Shares of the widths of crops of images from the first to the last column with ink; NaN where nothing stands out.

    Equal rows, one below the other, are looked at once and count as often as
    they are there. What lies beyond an image's edge is clear.
    """
    out = np.full(len(of), np.nan)
    high, wide = (np.array([px.shape[i] for px in images]) for i in (0, 1))
    for w in np.unique(wide).tolist():
        members = np.flatnonzero(wide == w)
        run, at, light, opaque = _alike([images[i] for i in members])
        above = np.zeros(len(images), int)
        above[members] = np.cumsum(high[members]) - high[members]
        # the part of each crop that lies on its image
        start, stop = above[of] + np.minimum(first, high[of]), above[of] + np.minimum(first + rows, high[of])
        x1, x2 = np.clip(left, 0, w), np.clip(left + columns, 0, w)
        seen = np.flatnonzero((wide[of] == w) & (rows > 1) & (columns > 1) & (start < stop) & (x1 < x2))
        if not len(seen):
            continue
        seen = seen[np.lexsort((x2[seen], x1[seen]))]
        kind = np.cumsum(np.r_[True, (np.diff(x1[seen]) != 0) | (np.diff(x2[seen]) != 0)]) - 1
        size = np.cumsum((run[stop[seen] - 1] - run[start[seen]] + 1) * (x2 - x1)[seen]) // TOGETHER
        for part in np.split(seen, 1 + np.flatnonzero((np.diff(kind) != 0) | (np.diff(size) != 0))):
            a, b, x, y = start[part], stop[part], x1[part[0]], x2[part[0]]
            runs = run[b - 1] - run[a] + 1
            begin = np.cumsum(runs) - runs
            crop = np.repeat(np.arange(len(part)), runs)
            ids = np.arange(len(crop)) + (run[a] - begin)[crop]
            times = np.minimum(at[ids + 1], b[crop]) - np.maximum(at[ids], a[crop])
            shade, solid = light[ids, x:y], opaque[ids, x:y]
            if solid.all():
                most, least, total = shade.max(axis=1), shade.min(axis=1), shade.sum(axis=1)
                count = np.full(len(ids), y - x)
            else:
                most, least = np.where(solid, shade, -np.inf).max(axis=1), np.where(solid, shade, np.inf).min(axis=1)
                total, count = np.where(solid, shade, 0.0).sum(axis=1), solid.sum(axis=1)
            most, least = np.maximum.reduceat(most, begin), np.minimum.reduceat(least, begin)
            mean = np.add.reduceat(total * times, begin) / np.maximum(1, np.add.reduceat(count * times, begin))
            darkest = np.maximum(35.0, np.minimum(245.0, np.minimum(mean - DISTANCE, most - 10)))
            dark = (solid & (shade <= darkest[crop, None])) * times[:, None]
            inked = np.add.reduceat(dark, begin, axis=0) >= np.maximum(1, (rows[part] * COLUMN_SHARE).astype(int))[:, None]
            width = columns[part]
            # clear columns beyond the edges come before the first and behind the last one with ink
            before, behind = x - left[part] + inked.argmax(axis=1), left[part] + width - y + inked[:, ::-1].argmax(axis=1)
            ratio = np.maximum(LEAST_RATIO, (width - behind - before) / width)
            out[part] = np.where((most - least >= CONTRAST) & inked.any(axis=1), np.where(ratio >= FULL_RATIO, 1.0, ratio), np.nan)
    return out


def ink_ratio(px: np.ndarray) -> float | None:
    """The share of a crop's width from its first to its last column with ink; None where nothing stands out.

    Ink is darker than the mean by DISTANCE, and a column has ink if COLUMN_SHARE
    of its height is. What lies beyond an image's edge is clear.
    """
    none = np.zeros(1, int)
    found = _ratios([px], none, none, none + px.shape[0], none, none + px.shape[1])[0]
    return None if np.isnan(found) else float(found)


def _band_ratios(images: list[np.ndarray], of: np.ndarray, boxes: np.ndarray, at: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Ratios of bands: the image that each is of, its box (4, n), its top and height as shares of the box's."""
    high, wide = (np.array([px.shape[i] for px in images])[of] for i in (0, 1))
    x1, y1, x2, y2 = boxes
    left, top = np.floor(x1 * wide).astype(int), y1 * high
    width, height = np.maximum(1.0, (x2 - x1) * wide), np.maximum(1.0, (y2 - y1) * high)
    tall = np.maximum(1.0, height * share)
    first = np.maximum(0.0, top + height * at - tall * LINE_PAD)
    last = np.minimum(high, top + height * at + tall * (1 + LINE_PAD))
    rows, columns, first = np.maximum(1.0, last - first).astype(int), width.astype(int), first.astype(int)
    out = _ratios(images, of, first, rows, left, columns)
    return np.where(np.isnan(out), 1.0, out)


def line_ratios(px: np.ndarray, box: tuple[float, float, float, float], bands: list[tuple[float, float]]) -> list[float]:
    """Ratios of a box's lines, given the tops and heights of their bands as shares of its height; 1 where a line has none."""
    n = len(bands)
    at, share = np.array(bands, float).reshape(n, 2).T
    return _band_ratios([px], np.zeros(n, int), np.repeat(np.array(box, float)[:, None], n, axis=1), at, share).tolist() if n else []


def _sizes(column: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_boxes, boxes = _sizes(batch.column(1)), batch.column(1).flatten()
        n_bands, bands = _sizes(boxes.field("bands")), boxes.field("bands").flatten()
        corners = np.stack([boxes.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")]).astype(float)
        at, share = (bands.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("top", "height"))
        box_of = np.repeat(np.arange(len(boxes)), n_bands)
        image_of = np.repeat(np.arange(len(batch)), n_boxes)[box_of]
        ratios, readable = np.ones(len(bands)), np.zeros(len(batch), bool)

        def measure(held: list[tuple[int, _File]]) -> None:
            ids = np.array([i for i, _ in held])
            here = np.flatnonzero(np.isin(image_of, ids)) if len(ids) < ids[-1] - ids[0] + 1 else np.arange(*np.searchsorted(image_of, [ids[0], ids[-1] + 1]))
            if len(here):
                ratios[here] = _band_ratios(_decoded_together([f for _, f in held]), np.searchsorted(ids, image_of[here]), corners[:, box_of[here]], at[here], share[here])  # noqa: B023

        held, size = [], 0
        for i, content in enumerate(batch.column(0)):
            try:
                file = _parsed(content.as_py() or b"")
            except (ValueError, zlib.error):
                continue
            readable[i] = True
            held.append((i, file))
            size += file.wide * file.high * 4
            if size >= TOGETHER:
                measure(held)
                held, size = [], 0
        if held:
            measure(held)
        offsets = np.concatenate(([0], np.cumsum(n_bands))).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ratios))
        yield pa.RecordBatch.from_arrays([boxes.field("layout_id").cast(pa.int64()), pa.array(np.repeat(readable, n_boxes)), found], names=["layout_id", "readable", "ratios"])


def ink_widths(images: DataFrame) -> DataFrame:
    """(layout_id, readable, ratios) for images: content, boxes, an array of (layout_id, x1, y1, x2, y2, bands of (top, height)).

    An image is read once for all its boxes. One that cannot be read gives ratios
    of 1 and readable false.
    """
    return images.select("content", "boxes").mapInArrow(_measured, "layout_id long, readable boolean, ratios array<double>")
