"""Words and marks of a text by their places: the one at an offset, and the nearest place of a word.

Places are characters (code points) from 0. A token is a run of word characters
(letters, digits, marks and underscores) or a run of other characters that are no
white space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import lists, pieces

# What words are made of, and white space.
WORD = r"\p{L}\p{N}\p{M}_"
SPACE = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


#: White space at the start of a text and the token behind it.
_AHEAD = rf"\A[{SPACE}]*(?:[{WORD}]+|[^{WORD}{SPACE}]+)?"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that it names several times, which is found once: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ahead(text: Column) -> Column:
    """(gap, token, kind) at the start of a text: the length of its white space, and what is behind it, empty at the end of the text."""

    def parted(found: Column) -> Column:
        return _once(F.length(F.regexp_extract(found, f"\\A[{SPACE}]+", 0)), lambda gap: F.struct(gap.alias("gap"), F.substring(found, gap + 1, F.length(found)).alias("token")))

    kind = lambda p: F.when(p["token"].rlike(f"\\A[{WORD}]"), "word").otherwise("punct").alias("kind")
    return _once(_once(F.regexp_extract(text, _AHEAD, 0), parted), lambda p: F.struct(p["gap"].alias("gap"), p["token"].alias("token"), kind(p)))


def token_at(text: Column, offset: Column) -> Column:
    """(start, end, token, kind) of the token at an offset, kept within the text; null without any token.

    An offset in white space counts as the nearer of the tokens beside it, the one before on ties.
    What lies before the offset is read backwards, so that either side is read up to the end of its token only.
    """

    def placed(s: Column) -> Column:
        at, behind = s["at"], _ahead(F.substring(s["text"], s["at"] + 1, s["size"]))
        return F.struct(at.alias("at"), behind.alias("behind"), _ahead(F.reverse(F.left(s["text"], at))).alias("before"))

    def token(start: Column, end: Column, of: Column, kind: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), of.alias("token"), kind.alias("kind"))

    def nearest(p: Column) -> Column:
        at, behind, before = p["at"], p["behind"], p["before"]
        whole = (before["gap"] == 0) & (before["token"] != "") & (before["kind"] == behind["kind"])
        left = F.when(whole, F.reverse(before["token"])).otherwise("")
        inside = token(at - F.length(left), at + F.length(behind["token"]), F.concat(left, behind["token"]), behind["kind"])
        last = token(at - before["gap"] - F.length(before["token"]), at - before["gap"], F.reverse(before["token"]), before["kind"])
        following = token(at + behind["gap"], at + behind["gap"] + F.length(behind["token"]), behind["token"], behind["kind"])
        none_left, none_right = before["token"] == "", behind["token"] == ""
        # the last character of the token before is one further away than its white space is long
        nearer = F.when(behind["gap"] < before["gap"] + 1, following).otherwise(last)
        return F.when(none_left & none_right, None).when((behind["gap"] == 0) & ~none_right, inside).when(none_left, following).when(none_right, last).otherwise(nearer)

    def sized(c: Column) -> Column:
        size = F.length(c)
        return F.struct(c.alias("text"), size.alias("size"), F.greatest(F.lit(0), F.least(F.coalesce(offset, F.lit(0)).cast("int"), size - 1)).alias("at"))

    return _once(_once(_once(F.coalesce(text, F.lit("")), sized), placed), nearest)


_PLACES = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("word", T.StringType())]))


@F.arrow_udf(_PLACES)
def word_places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The positional index of a text: all words with their places, in one pass; some texts at a time, as it is larger than they are."""
    import regex

    words = regex.compile(rf"[{WORD}]+")
    for texts in pieces(batches):
        sizes, at, found = [], [], []
        for x in texts:
            before = len(at)
            for m in words.finditer(x or ""):
                at.append(m.start())
                found.append(m[0])
            sizes.append(len(at) - before)
        yield lists(sizes, at=pa.array(at, pa.int32()), word=pa.array(found, pa.string()))


def nearest_word(index: Column, word: Column, offset: Column) -> Column:
    """The place of a whole word nearest to an offset, the first on ties; index: of word_places."""
    places = F.transform(F.filter(index, lambda p: p["word"] == word), lambda p: F.struct(F.abs(p["at"] - offset).alias("far"), p["at"].alias("at")))
    return F.array_min(places)["at"]


def _nearest(text: str, token: str, offset: int, whole: bool) -> int | None:
    """Outwards from the offset, by the nearest place on either side that is left."""
    import regex

    side = regex.compile(rf"[{WORD}]")

    def free(at: int) -> bool:
        end = at + len(token)
        return not whole or not (at and side.match(text, at - 1)) and not (end < len(text) and side.match(text, end))

    if not text or not token:
        return None
    start = max(0, min(len(text), offset))
    left, right = text.rfind(token, 0, start + len(token)) if start else -1, text.find(token, start)
    if left == right:
        left = text.rfind(token, 0, left + len(token) - 1) if left > 0 else -1
    while left >= 0 or right >= 0:
        if right < 0 or left >= 0 and abs(left - offset) <= abs(right - offset):
            if free(left):
                return left
            left = text.rfind(token, 0, left + len(token) - 1) if left > 0 else -1
        else:
            if free(right):
                return right
            right = text.find(token, right + 1)
    return None


@F.pandas_udf(T.IntegerType())
def nearest_place(text: pd.Series, token: pd.Series, offset: pd.Series, whole: pd.Series) -> pd.Series:
    """The place of any string nearest to an offset, the first on ties; if whole, with no word character beside it. Null without one."""
    return pd.Series([_nearest(t or "", k or "", int(o), bool(w)) for t, k, o, w in zip(text, token, offset, whole)], dtype="Int32")


def line_at(text: Column, offset: Column) -> Column:
    """Number of the line, from 0, that an offset lies in; without an offset, of the last."""
    c = F.coalesce(text, F.lit(""))
    head = F.left(c, F.greatest(F.lit(0), F.coalesce(offset, F.length(c)).cast("int")))
    return F.length(head) - F.length(F.translate(head, "\n", ""))


def offset_of_line(text: Column, line: Column) -> Column:
    """Where a line begins; the text's end if it has fewer."""
    c = F.coalesce(text, F.lit(""))
    n = F.coalesce(line, F.lit(0)).cast("int")
    lines = F.length(c) - F.length(F.translate(c, "\n", ""))
    return F.when(n <= 0, F.lit(0)).when(n > lines, F.length(c)).otherwise(F.length(F.call_function("substring_index", c, F.lit("\n"), n)) + 1)
