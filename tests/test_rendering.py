"""Font metrics, fitting and ink against plain versions."""

import math
import os
import random
import statistics
import struct
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import fonts, raster
from pagewright.operators import fitting

FONT = fonts.DEFAULT_FONT


def font_file(widths, codes, layout):
    """A small font: glyph i has widths[i]; codes: glyph by code point."""
    if layout == 12:
        body = struct.pack(">HHIII", 12, 0, 16 + 12 * len(codes), 0, len(codes)) + b"".join(struct.pack(">III", c, c, g) for c, g in sorted(codes.items()))
    else:
        runs = [*((c, c, g) for c, g in sorted(codes.items())), (0xFFFF, 0xFFFF, 0)]
        n = len(runs)
        # every other run goes by the glyph list, the others by a shift
        lists, jumps, shifts = [], [], []
        for i, (first, _, g) in enumerate(runs):
            by_list = i % 2 == 1 and first != 0xFFFF
            jumps.append(2 * (n - i) + 2 * len(lists) if by_list else 0)
            shifts.append(0 if by_list else (g - first) % 65536)
            lists += [g] if by_list else []
        words = [4, 16 + 8 * n + 2 * len(lists), 0, 2 * n, 0, 0, 0, *(r[1] for r in runs), 0, *(r[0] for r in runs), *shifts, *jumps, *lists]
        body = b"".join(struct.pack(">H", w) for w in words)
    tables = {
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 10 if layout == 12 else 1, 12) + body,
        b"head": bytes(18) + struct.pack(">H", 1000) + bytes(34),
        b"hhea": bytes(34) + struct.pack(">H", len(widths) - 1),
        b"hmtx": b"".join(struct.pack(">HH", w, 0) for w in widths[:-1]) + struct.pack(">H", 0),
    }
    head, data, at = b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for name, t in tables.items():
        head += name + struct.pack(">III", 0, at + len(data), len(t))
        data += t
    return head + data


@pytest.mark.parametrize("layout", [4, 12])
def test_advances_of_a_font_file(spark, tmp_path, layout):
    codes = {32: 1, 65: 2, 66: 3, 233: 4, 0x416: 5} | ({0x1F600: 6} if layout == 12 else {})
    (tmp_path / "a.ttf").write_bytes(font_file([500, 250, 700, 680, 550, 900, 1000, 0], codes, layout))
    row = fonts.glyph_advances(spark, str(tmp_path)).first()
    widths = [500, 250, 700, 680, 550, 900, 1000]
    assert (row.units, row.missing) == (1000, 500) and row.advances == {c: widths[g] for c, g in codes.items()}
    for bad in (b"", b"no font at all", b"\0\1\0\0\0\0"):
        with pytest.raises((ValueError, struct.error)):
            fonts.parsed(bad + bytes(8) if bad.startswith(b"\0") else bad)


@pytest.mark.skipif(not os.path.exists(FONT), reason="no font file here")
def test_a_font_of_this_machine():
    m = fonts.metrics()
    assert m.units == 2048 and m.advances[ord("i")] < m.advances[ord("n")] < m.advances[ord("W")] and 0x416 in m.advances
    assert fonts.metrics("/nowhere.ttf") == fonts.plain_metrics()


def plain_lines(text, width, limit):
    """Lines word by word, as the rule says it; width: of a string."""
    out = []
    for raw in text.splitlines() or [""]:
        if not raw:
            out.append("")
            continue
        current = ""
        for word in raw.split(" "):
            candidate = f"{current} {word}" if current else word
            if width(candidate) <= limit:
                current = candidate
                continue
            if current:
                out.append(current)
            piece = ""
            for ch in word:
                if piece and width(piece + ch) > limit:
                    out.append(piece)
                    piece = ""
                piece += ch
            out.append(piece)
            current = ""
        if current:
            out.append(current)
    return out or [""]


def some_texts(n=150):
    r = random.Random(2)
    word = lambda: "".join(r.choice("ilmWMaé日 ") for _ in range(r.randint(0, 9)))
    return ["", " ", "\n", "a\n\n b ", "x" * 200, "\r\na\x0bb", "a  ", "   a", *("".join(r.choice(["\n", " ", "  "]) + word() for _ in range(r.randint(1, 40))) for _ in range(n))]


def test_lines_equal_a_word_by_word_version():
    m = fonts.plain_metrics()
    table = m.table()
    width = lambda s: sum(m.advances.get(ord(c), m.missing) for c in s)
    for text in some_texts():
        t = fitting.Text(text, table)
        for limit in (1, 60, 333, 1000, 5000):
            got = t.lines(limit)
            assert [text[a:b] for a, b in got] == plain_lines(text, width, limit), (text, limit)
            for most in (0, 1, 3, len(got) - 1, len(got)):
                assert t.lines(limit, most) == (got if len(got) <= most else None)


def test_sizes_equal_a_scan_of_all_sizes(spark):
    m = fonts.plain_metrics()
    r = random.Random(4)
    rows = [(i, t, r.choice(["markdown", "html", "latex", " HTML ", None]), r.randint(1, 500), r.randint(1, 400)) for i, t in enumerate([*some_texts(80), None, "word " * 5000])]
    got = {x.layout_id: x for x in fitting.fitted_texts(spark.createDataFrame(rows, "layout_id long, content string, output_format string, width int, height int"), m).collect()}
    assert len(got) == len(rows)
    for i, text, form, width, height in rows:
        ratio = {"html": 1.02, "latex": 1.1}.get((form or "").strip().lower(), 1.08)
        measure = lambda s: sum(m.advances.get(ord(c), m.missing) for c in s)
        best = None
        for size in range(6, max(6, min(72, width, height)) + 1):
            lines = plain_lines(text or "", measure, width * 100 // size)
            if max(1, round(size * ratio)) * len(lines) <= height and max(map(measure, lines)) * size <= width * 100:
                best = size
        size = best or 6
        lines = plain_lines(text or "", measure, width * 100 // size)
        assert (got[i].size, got[i].fits, [x.text for x in got[i].lines]) == (size, best is not None, lines), i
        assert all(math.isclose(x.width, measure(x.text) * size / 100) for x in got[i].lines)


def plain_plans(lines, form, target):
    several, clamp = len(lines) > 1, lambda x: max(0.18, min(8.0, x))
    words, letters = (6.0, 1.2) if form == "markdown" and several else (3.5, 0.8)
    glyphs = lambda s: sum(c not in " \n\r\t" for c in s)
    marks = lambda s: any(unicodedata.category(c).startswith("M") for c in s)
    plans = []
    for text, width in lines:
        word = letter = 0.0
        if form == "markdown" and not marks(text) and width > 0:
            n, gap = text.count(" "), target - width
            if n and gap > target * 0.01:
                word = min(words, gap / n)
            gap = target - width - n * word
            if glyphs(text) > 1 and gap > target * 0.004:
                letter = min(letters, gap / (glyphs(text) - 1))
        full = width + text.count(" ") * word + max(0, glyphs(text) - 1) * letter
        scale = 1.0
        if form != "html" and full > 0:
            scale = target / full
            if form == "markdown" and marks(text):
                scale = min(1.0, scale)
            scale = clamp(scale)
        plans.append((word, letter, scale))
    if form == "markdown" and several:
        text, width = lines[-1]
        word, letter, scale = (statistics.median(p[k] for p in plans[:-1]) for k in range(3))
        if marks(text):
            word = letter = 0.0
        full = width + text.count(" ") * word + max(0, glyphs(text) - 1) * letter
        if full > 0 and text.strip():
            fit = clamp(target / full)
            plans[-1] = (word, letter, clamp(fit if fit < 1 else 1.0 if marks(text) else max(1.0, min(max(0.18, scale), fit))))
    return plans


def test_plans_equal_plain_ones(spark):
    r = random.Random(7)
    rows = []
    for i in range(200):
        lines = [("".join(r.choice("ab  é" + ("é́" if r.random() < 0.1 else "c")) for _ in range(r.randint(0, 12))), r.choice([0.0, r.random() * 300])) for _ in range(r.randint(1, 6))]
        rows.append((i, lines, r.choice(["markdown", "markdown", "html", "latex"]), r.randint(1, 300)))
    df = spark.createDataFrame(rows, "id long, lines array<struct<text:string,width:double>>, form string, width int")
    got = {x.id: x.p for x in df.select("id", fitting.line_plans(F.col("lines"), F.col("form"), F.col("width")).alias("p")).collect()}
    for i, lines, form, width in rows:
        assert np.allclose([tuple(p) for p in got[i]], plain_plans(lines, form, width)), (lines, form, width)


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4, 4, 3]])
def test_filters_of_images_are_undone(kinds):
    px = np.random.default_rng(5).integers(0, 256, (23, 17, 4), dtype=np.uint8)
    assert (raster.decoded(raster.encoded(px, np.resize(kinds, 23))) == px).all()
    assert (raster.decoded(raster.encoded(px[:1, :1])) == px[:1, :1]).all()


def image(wide, high, depth, colour, rows, extra=()):
    """A file of rows of bytes without filters."""
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    flat = b"".join(b"\0" + x for x in rows)
    head = struct.pack(">IIBBBBB", wide, high, depth, colour, 0, 0, 0)
    return raster._MARK + b"".join(chunk(k, b) for k, b in [(b"IHDR", head), *extra, (b"IDAT", zlib.compress(flat)), (b"IEND", b"")])


def test_kinds_of_images():
    assert raster.decoded(image(3, 1, 1, 0, [b"\xa0"]))[0, :, 0].tolist() == [255, 0, 255]
    assert raster.decoded(image(2, 1, 4, 0, [b"\x3f"], [(b"tRNS", b"\0\x0f")]))[0].tolist() == [[51, 51, 51, 255], [255, 255, 255, 0]]
    assert raster.decoded(image(2, 1, 8, 2, [bytes(range(6))]))[0].tolist() == [[0, 1, 2, 255], [3, 4, 5, 255]]
    assert raster.decoded(image(1, 1, 16, 4, [b"\x12\x34\x56\x78"]))[0].tolist() == [[18, 18, 18, 86]]
    assert raster.decoded(image(2, 1, 2, 3, [b"\x40"], [(b"PLTE", bytes(range(6))), (b"tRNS", b"\x07")]))[0].tolist() == [[3, 4, 5, 255], [0, 1, 2, 7]]
    for bad in (b"", b"GIF89a", raster._MARK, image(1, 1, 8, 0, [b"a"]).replace(struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0), struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 1))):
        with pytest.raises(ValueError):
            raster.decoded(bad)


def plain_ink(px):
    """The rule, pixel by pixel."""
    high, wide = len(px), len(px[0])
    light = lambda p: 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]
    seen = [light(p) for row in px for p in row if p[3] >= 24]
    if high < 2 or wide < 2 or not seen or max(seen) - min(seen) < 18:
        return None
    limit = max(35, min(245, sum(seen) / len(seen) - 30, max(seen) - 10))
    need = max(1, int(high * 0.18))
    dark = [c for c in range(wide) if sum(px[r][c][3] >= 24 and light(px[r][c]) <= limit for r in range(high)) >= need]
    if not dark:
        return None
    ratio = max(0.2, (dark[-1] - dark[0] + 1) / wide)
    return 1.0 if ratio >= 0.97 else ratio


def test_ink_equals_a_pixel_by_pixel_version():
    r = np.random.default_rng(6)
    for _ in range(60):
        px = np.full((r.integers(1, 20), r.integers(1, 60), 4), r.integers(150, 256), np.uint8)
        px[..., 3] = 255
        for _ in range(r.integers(0, 4)):
            y, x = r.integers(0, px.shape[0]), r.integers(0, px.shape[1])
            px[y : y + r.integers(1, 9), x : x + r.integers(1, 30), : r.integers(1, 5)] = r.integers(0, 200)
        got, want = raster.ink_ratio(px), plain_ink(px.tolist())
        assert got == want or math.isclose(got, want)


def test_ink_of_lines_at_the_edges_of_an_image(spark):
    px = np.full((40, 100, 4), 255, np.uint8)
    px[2:8, 10:60, :3] = 0
    px[22:28, 0:97, :3] = 0
    bands = [{"top": k / 4, "height": 0.25} for k in range(4)]
    boxes = [{"layout_id": 1, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "bands": bands}, {"layout_id": 2, "x1": 0.5, "y1": 0.5, "x2": 1.5, "y2": 1.5, "bands": bands[:2]}, {"layout_id": 3, "x1": 0.0, "y1": 0.0, "x2": 0.1, "y2": 0.1, "bands": []}]
    kind = "content binary, boxes array<struct<layout_id:long,x1:double,y1:double,x2:double,y2:double,bands:array<struct<top:double,height:double>>>>"
    df = spark.createDataFrame([(raster.encoded(px), boxes), (b"broken", boxes[:1]), (None, boxes[2:]), (raster.encoded(px), None)], kind)
    got = [tuple(x) for x in raster.ink_widths(df).collect()]
    assert got[0] == (1, True, [0.5, 1.0, 1.0, 1.0])
    # half of the second crop lies beyond the edge and is clear
    assert got[1] == (2, True, [0.47, 1.0])
    assert got[2:] == [(3, True, []), (1, False, [1.0] * 4), (3, False, [])]
