"""Text fitted into boxes: the largest font size whose wrapped lines fit, and how each line is stretched to the box.

Widths are sums of advances, in whole units of the font, so a size fits or not
without rounding. A text's advances are summed up once; a line then ends where a
binary search in the sums says, so the work for one size grows with the lines of
the box and not with the text. If a size fits, so does each smaller one, and the
largest is found by halving the range of sizes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fonts import Metrics, metrics
from ..functions.text import line_height, lists, pieces

# Sizes, limits of spacing for one line and for several, shares of the width below which a gap is left, and the range of scales.
SMALLEST, LARGEST = 6, 72
WORD_SPACE, LETTER_SPACE = (3.5, 6.0), (0.8, 1.2)
WORD_GAP, LETTER_GAP = 0.01, 0.004
SCALES = (0.18, 8.0)
_LINE_ENDS = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


_TOGETHER = 1 << 12  # characters of texts whose advances are summed up together
_SPACE, _ENDS = 32, [*map(ord, "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")]


class _Sums:
    """Of a string: the sums of its advances, where its spaces are, and the sums without spaces and ends of lines."""

    def __init__(self, text: str, table: np.ndarray):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        advances = table[codes]
        self.upto: list[int] = [0, *np.cumsum(advances, dtype=np.int64).tolist()]
        self.spaces: list[int] = np.flatnonzero(codes == _SPACE).tolist()
        self.shown = np.where((codes == _SPACE) | np.isin(codes, _ENDS), 0, advances)
        self.ink = np.cumsum(self.shown, dtype=np.int64)

    def broadest(self, sizes: np.ndarray) -> np.ndarray:
        """The widest advance of each part of the string, which has these sizes one after the other."""
        out, some = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes)
        if len(some):
            out[some] = np.maximum.reduceat(self.shown, (np.cumsum(sizes) - sizes)[some])
        return out


class Text:
    """A text with the sums of its advances, wrapped again and again at other widths; a part of a longer string with the sums of that."""

    def __init__(self, text: str, table: np.ndarray):
        one = next(Text.several([text], table))
        self.__dict__ = one.__dict__

    def _set(self, of: _Sums, first: int, stop: int, ink: int, broadest: int) -> None:
        self.text, self.first, self.upto = of.text, first, of.upto
        spaces, upto = of.spaces, of.upto
        self.hard: list[tuple[list[int], list[int], list[int]]] = []  # starts of words, ends, and sums up to those, of each line of the text
        at, nth = first, bisect_left(spaces, first)
        pieces = [m.span() for m in _LINE_ENDS.finditer(of.text, first, stop)]
        pieces.append((stop, stop))
        for start, after in pieces:
            if start > at or after > start or first == stop:
                last = bisect_left(spaces, start, nth)
                own, nth = spaces[nth:last], last
                ends = [*own, start]
                self.hard.append(([at, *[x + 1 for x in own]], ends, [upto[x] for x in ends]))
            at = after
        #: Advances of all that has to stand on some line, and the widest of those.
        self.ink, self.broadest = ink, broadest

    @classmethod
    def several(cls, texts: list[str | None], table: np.ndarray) -> Iterator[Text]:
        """Texts of which some at a time have their advances summed up together."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and size < _TOGETHER:
                size += len(texts[end] or "")
                end += 1
            some, start = [x or "" for x in texts[start:end]], end
            of = _Sums("".join(some), table)
            sizes = np.array([len(x) for x in some], int)
            stops = np.cumsum(sizes)
            ink = np.diff(np.append(0, of.ink)[np.append(0, stops)])
            for first, stop, shown, broadest in zip((stops - sizes).tolist(), stops.tolist(), ink.tolist(), of.broadest(sizes).tolist()):
                one = cls.__new__(cls)
                one._set(of, first, stop, shown, broadest)
                yield one

    def fits(self, limit: int, most: int) -> bool:
        """Whether lines() of the limit has no more than `most`, and none is wider than the limit."""
        # no line is wider where no character is; then all advances have to go into so many lines
        if self.broadest > limit or self.ink > most * limit:
            return False
        upto, out = self.upto, 0
        for starts, ends, sums in self.hard:
            if starts[0] == ends[-1]:
                out += 1
            k, n = 0, len(starts)
            while k < n:
                if out > most:
                    return False
                begin = starts[k]
                if begin == ends[k]:
                    k += 1
                    continue
                behind = bisect_right(sums, upto[begin] + limit, k)
                if behind > k:
                    out += 1
                    k = behind
                if k < n:
                    at, end = starts[k], ends[k]
                    out += at == end
                    while at < end and out <= most:
                        at = max(at + 1, bisect_right(upto, upto[at] + limit, at, end + 1) - 1)
                        out += 1
                    k += 1
        return max(1, out) <= most

    def lines(self, limit: int, most: int | None = None) -> list[tuple[int, int]] | None:
        """(start, end) of each line where none is wider than limit, but a single character may be; None if there are more than `most`.

        Words are put on a line while they fit. The word that does not fit stands
        alone, in pieces if it is wider than a line, and the next line begins behind it.
        """
        out: list[tuple[int, int]] = []
        upto = self.upto
        for starts, ends, sums in self.hard:
            if starts[0] == ends[-1]:
                out.append((starts[0], starts[0]))
            k, n = 0, len(starts)
            while k < n:
                if most is not None and len(out) > most:
                    return None
                begin = starts[k]
                if begin == ends[k]:  # a space at the start of a line
                    k += 1
                    continue
                fits = bisect_right(sums, upto[begin] + limit, k)
                if fits > k:
                    out.append((begin, ends[fits - 1]))
                    k = fits
                if k < n:
                    self._pieces(starts[k], ends[k], limit, out, most)  # an empty one is an empty line
                    k += 1
        out = out or [(self.first, self.first)]
        return None if most is not None and len(out) > most else out

    def _pieces(self, at: int, end: int, limit: int, out: list[tuple[int, int]], most: int | None) -> None:
        if at == end:
            out.append((at, at))
        while at < end and (most is None or len(out) <= most):
            stop = bisect_right(self.upto, self.upto[at] + limit, at, end + 1) - 1
            stop = max(at + 1, stop)
            out.append((at, stop))
            at = stop

    def widest(self, lines: list[tuple[int, int]]) -> int:
        return max(self.upto[b] - self.upto[a] for a, b in lines)


def fits(text: Text, units: int, size: int, ratio: float, width: int, height: int) -> bool:
    """Whether the text in this size, wrapped to the width, is no higher and no wider than the box."""
    return text.fits(width * units // size, height // max(1, round(size * ratio)))


def largest_size(text: Text, units: int, ratio: float, width: int, height: int) -> int:
    """The largest size that fits, or the smallest one if none does."""
    low, high = SMALLEST, max(SMALLEST, min(LARGEST, width, height))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(text, units, middle, ratio, width, height) else (low, middle - 1)
    return low


def _fitted(batches: Iterator[pa.RecordBatch], font: Metrics) -> Iterator[pa.RecordBatch]:
    """Lines are gathered as flat columns, for few texts at a time."""
    table = font.table()
    for whole in batches:
        start = 0
        for held in pieces(iter([whole.column(0)])):
            batch = whole.slice(start, len(held))
            start += len(held)
            ratios, widths, heights = (batch.column(i).to_pylist() for i in (1, 2, 3))
            out: list[list] = [[], [], []]
            sizes, lines, wide = [], [], []
            for text, ratio, width, height in zip(Text.several(held, table), ratios, widths, heights):
                size = largest_size(text, font.units, ratio, width, height)
                found = text.lines(width * font.units // size)
                high = max(1, round(size * ratio))
                own = [text.upto[b] - text.upto[a] for a, b in found]
                for column, value in zip(out, (size, high, high * len(found) <= height and max(own) * size <= width * font.units)):
                    column.append(value)
                sizes.append(len(found))
                lines += [text.text[a:b] for a, b in found]
                wide += [x * size / font.units for x in own]
            kept = list(range(4, batch.num_columns))
            columns = [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), lists(sizes, text=pa.array(lines, pa.string()), width=pa.array(wide, pa.float64()))]
            names = [batch.schema.names[i] for i in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], names=[*names, "size", "line_height", "fits", "lines"])


def fitted_texts(boxes: DataFrame, font: Metrics | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(layout_id, keep, size, line_height, fits, lines) for boxes: layout_id, content, output_format, width and height in pixels; keep: further columns of theirs.

    lines: the text and the width in pixels of each. A null or empty content is
    one empty line; a text that does not fit in the smallest size has all of its
    lines in that size, and fits is false.
    """
    font = font or metrics()
    high = line_height(F.lower(F.trim("output_format"))).cast("double")
    whole = lambda c: F.greatest(F.lit(1), F.col(c).cast("int"))
    kept = [F.col("layout_id").cast("long"), *(F.col(c).alias(f"__{c}") for c in keep)]
    rows = boxes.select(F.col("content").cast("string"), F.coalesce(high, F.lit(1.08)).alias("ratio"), whole("width").alias("width"), whole("height").alias("height"), *kept)
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes[4:])
    found = rows.mapInArrow(lambda it: _fitted(it, font), f"{kinds}, size int, line_height int, fits boolean, lines array<struct<text:string,width:double>>")
    return found.withColumnsRenamed({f"__{c}": c for c in keep})


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that it names several times, which is found once: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _median(values: Column) -> Column:
    def middle(ranked: Column) -> Column:
        n = F.size(ranked)
        return (F.get(ranked, ((n - 1) / 2).cast("int")) + F.get(ranked, (n / 2).cast("int"))) / 2

    # none is null; sort_array compares values themselves, array_sort calls a function for each comparison
    return _once(F.sort_array(values), middle)


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(SCALES[0]), F.least(F.lit(SCALES[1]), c))


def _measured(line: Column) -> Column:
    """Width, spaces, characters that are none, combining marks and blankness of a line."""
    text = line["text"]
    return F.struct(
        line["width"].alias("width"), (F.length(text) - F.length(F.translate(text, " ", ""))).alias("spaces"), F.length(F.translate(text, " \n\r\t", "")).alias("glyphs"),
        text.rlike(r"\p{M}").alias("combining"), (F.trim(text) == "").alias("blank"),
    )


def _stretched(m: Column, spread: Column, word: Column, letter: Column) -> Column:
    return m["width"] + F.when(spread, m["spaces"] * word + F.greatest(F.lit(0), m["glyphs"] - 1) * letter).otherwise(F.lit(0.0))


def line_plans(lines: Column, output_format: Column, width: Column) -> Column:
    """How each line is brought to the width of its box: an array of (word_spacing, letter_spacing, horizontal_scale).

    Markdown is spread first between words, then between letters, up to limits;
    what is left is made up by scaling, which html does without. Lines with
    combining marks are not spread and not widened. The last line of several takes
    the medians of those before it, and is not scaled beyond their median.
    """
    markdown, html = output_format == "markdown", output_format == "html"
    several, target = F.size(lines) > 1, width.cast("double")
    limit = lambda pair: F.when(markdown & several, F.lit(pair[1])).otherwise(F.lit(pair[0]))

    # one array after the other, so that each value of a line is found once
    def spread_words(m: Column) -> Column:
        spread, gap = markdown & ~m["combining"] & (m["width"] > 0), target - m["width"]
        word = F.when(spread & (m["spaces"] > 0) & (gap > target * WORD_GAP), F.least(limit(WORD_SPACE), gap / F.nullif(m["spaces"], F.lit(0)))).otherwise(F.lit(0.0))
        return F.struct(m.alias("m"), spread.alias("spread"), word.alias("word_spacing"))

    def left_over(x: Column) -> Column:
        return F.struct(x["m"].alias("m"), x["spread"].alias("spread"), x["word_spacing"].alias("word_spacing"), (target - x["m"]["width"] - x["m"]["spaces"] * x["word_spacing"]).alias("left"))

    def spread_letters(x: Column) -> Column:
        glyphs = x["m"]["glyphs"]
        letter = F.when(x["spread"] & (glyphs > 1) & (x["left"] > target * LETTER_GAP), F.least(limit(LETTER_SPACE), x["left"] / F.nullif(glyphs - 1, F.lit(0)))).otherwise(F.lit(0.0))
        return F.struct(x["m"].alias("m"), x["word_spacing"].alias("word_spacing"), letter.alias("letter_spacing"))

    def full_width(x: Column) -> Column:
        return F.struct(x["m"].alias("m"), x["word_spacing"].alias("word_spacing"), x["letter_spacing"].alias("letter_spacing"), _stretched(x["m"], F.lit(True), x["word_spacing"], x["letter_spacing"]).alias("full"))

    def scaled(x: Column) -> Column:
        scale = target / F.nullif(x["full"], F.lit(0.0))
        scale = F.when(markdown & x["m"]["combining"], F.least(F.lit(1.0), scale)).otherwise(scale)
        return F.struct(x["m"].alias("m"), x["word_spacing"].alias("word_spacing"), x["letter_spacing"].alias("letter_spacing"), F.when(html | scale.isNull(), F.lit(1.0)).otherwise(_clamped(scale)).alias("horizontal_scale"))

    def last(plans: Column) -> Column:
        before, m = F.slice(plans, F.lit(1), F.size(plans) - 1), F.element_at(plans, -1)["m"]
        # an array of structs gives the array of a field
        medians = F.struct(m.alias("m"), (~m["combining"]).alias("spread"), *(_median(before[c]).alias(c) for c in ("word_spacing", "letter_spacing", "horizontal_scale")))

        def fitted(x: Column) -> Column:
            return F.struct(x.alias("x"), _stretched(x["m"], x["spread"], x["word_spacing"], x["letter_spacing"]).alias("full"))

        def planned(y: Column) -> Column:
            x, full = y["x"], y["full"]
            fit = _clamped(target / F.nullif(full, F.lit(0.0)))
            wide = F.when(fit < 1, fit).when(~x["spread"], F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.greatest(F.lit(SCALES[0]), x["horizontal_scale"]), fit)))
            own = [F.when(x["spread"], x[c]).otherwise(F.lit(0.0)).alias(c) for c in ("word_spacing", "letter_spacing")]
            # a blank last line, or one without width, stays as it is
            return F.when((full <= 0) | x["m"]["blank"], _plan(F.element_at(plans, -1))).otherwise(F.struct(*own, _clamped(wide).alias("horizontal_scale")))

        return _once(_once(medians, fitted), planned)

    plans = lines
    for step in (_measured, spread_words, left_over, spread_letters, full_width, scaled):
        plans = F.transform(plans, step)
    return _once(plans, lambda p: F.when(markdown & several, F.concat(F.transform(F.slice(p, F.lit(1), F.size(p) - 1), _plan), F.array(last(p)))).otherwise(F.transform(p, _plan)))


def _plan(x: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in ("word_spacing", "letter_spacing", "horizontal_scale")))
