"""Column functions and vectorised functions over transcribed text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalise import strip

# Glyphs folded to plain quotes.
SINGLE_QUOTES = "`´‘’‚‛ʼʹʻ′＇‹›"
DOUBLE_QUOTES = "“”„‟″＂"
# Letters that look like a letter of the Tatar alphabet, and that letter.
LOOKALIKES = (
    ("ə", "ә"), ("Ə", "Ә"),
    ("eėĕẹéèêëēěęẽẻȅȇếềểễệ", "е"), ("EĖĔẸÉÈÊËĒĚĘẼẺȄȆẾỀỂỄỆ", "Е"),
    ("oọőôöòóõøōŏȯȱỏốồổỗộ", "о"), ("OỌŐÔÖÒÓÕØŌŎȮȰỎỐỒỔỖỘ", "О"),
    ("aàáâãäåāăąȁȃȧȩǎǟǡǻ", "а"), ("AÀÁÂÃÄÅĀĂĄȀȂȦȨǍǞǠǺ", "А"),
    ("yýỳỹỷỵȳÿ", "у"), ("YÝỲỸỶỴȲŸ", "У"),
    ("cƈċ", "с"), ("CƇĊ", "С"),
    ("xẋẍҳӽӿ", "х"), ("XẊẌҲӼӾ", "Х"),
    ("pṗṕ", "р"), ("PṖṔ", "Р"),
    ("hħḥḧḩḫḣ", "һ"), ("HĦḤḦḨḪḢ", "Һ"),
    ("kķĸқҡҟҝќ", "к"), ("KĶҚҠҞҜЌ", "К"),
    ("ґғ", "г"), ("ҐҒ", "Г"),
)
MOST_WARNINGS = 200


#: Characters of a text that its functions hold results of at once, as those may be many times as large as the text.
PIECE = 1 << 18
#: Characters that composing may change or join with those before them, and others near those; none of them is below U+0300.
_UNSETTLED = (
    r"\u0300-\u036F\u0374\u037E\u0387\u0483-\u0487\u0591-\u1FFF\u2000\u2001\u20D0-\u20FF\u2126\u212A\u212B\u2329\u232A\u2ADC\u2CEF-\u2CF1\u2D7F\u2DE0-\u2DFF"
    r"\u302A-\u302F\u3099\u309A\uA66F-\uA6FF\uA802-\uABFF\uF900-\uFAFF\uFB1D-\uFB4F\uFE20-\uFE2F\x{10000}-\x{10FFFF}"
)


def pieces(batches: Iterator[pa.Array], most: int = PIECE) -> Iterator[list[str | None]]:
    """The texts of batches in runs of about so many characters, or of one text."""
    for batch in batches:
        held, size = [], 0
        for x in batch:
            held.append(x.as_py())
            size += len(held[-1] or "")
            if size >= most:
                yield held
                held, size = [], 0
        if held:
            yield held


def lists(sizes: list[int], **fields: pa.Array) -> pa.ListArray:
    """An array of lists of structs from the sizes of the lists and the fields of all structs."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def nfc(c: Column | str) -> Column:
    """Composed Unicode form; null becomes ''. Only texts with a character that may not be settled go to Python."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.coalesce(_composed(F.when(text.rlike(rf"[\u0300-\x{{10FFFF}}&&[{_UNSETTLED}]]"), text)), text)


def fold_quotes(c: Column) -> Column:
    return F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


_QUOTES = str.maketrans(SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
_DOLLARS = re.compile(r"(?<!\\)((?:\\\\)*)(\$\$?)")


def _fold_outside_math(text: str) -> str:
    """Quotes are folded outside of $...$ and $$...$$; what follows an unclosed delimiter stays."""
    out, at, opened = [], 0, None
    for m in _DOLLARS.finditer(text):
        if opened is None:
            out.append(text[at : m.start(2)].translate(_QUOTES))
            at, opened = m.start(2), m[2]
        elif m[2] == opened:
            out.append(text[at : m.end(2)])
            at, opened = m.end(2), None
    rest = text[at:]
    out.append(rest if opened else rest.translate(_QUOTES))
    return "".join(out)


@F.pandas_udf(T.StringType())
def _folded_outside_math(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _fold_outside_math(x))


def fold_quotes_outside_math(c: Column) -> Column:
    """Quotes folded outside of math; null becomes ''. Only texts with both a dollar sign and such a quote go to Python."""
    text = F.coalesce(c, F.lit(""))
    mixed = text.contains("$") & text.rlike(f"[{SINGLE_QUOTES}{DOUBLE_QUOTES}]")
    return F.coalesce(_folded_outside_math(F.when(mixed, text)), fold_quotes(text))


def normalised_content(content: Column, output_format: Column) -> Column:
    composed = nfc(content)
    return F.when(output_format == "latex", composed).when(output_format == "markdown", fold_quotes_outside_math(composed)).otherwise(fold_quotes(composed))


def without_heading_mark(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"^\s{0,3}#{1,6}\s*", ""))


_WRAPPED = re.compile(r"(\*\*\*|___|\*\*|__|\*|_)(.*\S.*)\1", re.S)
_TAIL = re.compile(r"""[.,;:!?…»”'"\\)\]}]*$""")


def _without_emphasis(text: str) -> str:
    value = text.strip()
    cut = _TAIL.search(value).start()
    core, tail = value[:cut].strip(), value[cut:]
    while m := _WRAPPED.fullmatch(core):
        core = m[2].strip()
    return (core + tail).strip()


@F.pandas_udf(T.StringType())
def without_full_emphasis(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _without_emphasis(x or ""))


def _headed(text: str, level: int) -> str:
    lines = text.strip().splitlines()
    for i, line in enumerate(lines):
        if line.strip():
            body = re.sub(r"^\s{0,3}#{1,6}\s*", "", line).strip() or line.strip()
            lines[i] = f"{'#' * max(1, min(6, level))} {_without_emphasis(body)}".strip()
            return "\n".join(lines).strip()
    return text.strip()


@F.pandas_udf(T.StringType())
def with_heading_level(s: pd.Series, level: pd.Series) -> pd.Series:
    """The first line that is not blank as a heading of the level."""
    return pd.Series([_headed(x or "", int(n)) for x, n in zip(s, level)])


def plain_latex(c: Column) -> Column:
    """LaTeX without a fence and without one pair each of \\[ \\], $$ $$ and $ $."""
    text = strip(c)
    text = strip(F.regexp_replace(text, r"(?s)\A(?:```[^\n]*|~~~[^\n]*)\n(.*?)\n?[ \t]*(?:```|~~~)\z", "$1"))
    for pattern in (r"(?s)\A\\\[(.+)\\\]\z", r"(?s)\A\$\$(.+)\$\$\z", r"(?s)\A\$(.+)\$\z"):
        text = strip(F.regexp_replace(text, pattern, "$1"))
    return text


_ORDERED = r"^((?:\d+|[A-Za-zА-Яа-яЁё])[.)])\s+"
_BULLET = r"^[-*•‣▪◦]\s+"


def list_line(c: Column, indent: Column) -> Column:
    """A list item with its number or a dash, two spaces for each level before it."""
    text = strip(c)
    marker = F.regexp_extract(text, _ORDERED, 1)
    rest = strip(F.when(marker != "", F.regexp_replace(text, _ORDERED, "")).otherwise(F.regexp_replace(text, _BULLET, "")))
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), indent)), F.when(marker != "", marker).otherwise("-"), F.lit(" "), F.when(rest == "", text).otherwise(rest))
    return F.when(text == "", text).otherwise(F.regexp_replace(line, r"(?U)\s+$", ""))


#: Where lines end, fences of code, and a span between equal runs of back-ticks or a run that nothing closes.
_LINE_END = re.compile("\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]")
_FENCE = re.compile("`{3,}|~{3,}")
_CODE_SPAN = re.compile("(`++)(?:.*?\\1)?")
_CYRILLIC = "[\u0400-\u04ff]"
_MASK = "\0"  # no letter and no back-tick: stands for each character of code
_PLAIN = str.maketrans({odd: target for chars, target in LOOKALIKES for odd in chars})
_WARNING = "array<struct<line_index:int,token:string,normalized_token:string,token_start:int,token_end:int,replacements:array<struct<`from`:string,`to`:string>>>>"


def without_spans(line: str) -> str:
    """A line of the same length in which code between back-ticks is masked."""
    return _CODE_SPAN.sub(lambda m: _MASK * len(m[0]), line) if "`" in line else line


def _odd_words(text: str, most: int | None) -> list[tuple]:
    """Words of a text in reading order that look like others; each character is looked at a fixed number of times."""
    import regex

    cyrillic, part, word = regex.compile(_CYRILLIC), regex.compile(f"[^{_MASK}]+"), regex.compile(r"[\p{L}\p{N}_]+")
    out: list[tuple] = []
    fence = ""
    for n, line in enumerate(_LINE_END.split(text)):
        if fence:
            fence = "" if line.startswith(fence) else fence
            continue
        if mark := _FENCE.match(line):
            fence = mark[0]
            continue
        for piece in part.finditer(without_spans(line)) if cyrillic.search(line) else ():
            if not cyrillic.search(piece[0]):
                continue
            for m in word.finditer(piece[0]):
                plain = m[0].translate(_PLAIN)
                if plain == m[0] or not cyrillic.search(m[0]) and len(regex.findall(r"\p{L}", m[0])) != 1:
                    continue
                at = piece.start() + m.start()
                out.append((n, m[0], plain, at, at + len(plain), [(x, y) for x, y in zip(m[0], plain) if x != y]))
                if len(out) == most:
                    return out
    return out


def lookalikes(df: DataFrame, column: str, name: str = "warnings", most: int | None = MOST_WARNINGS) -> DataFrame:
    """df with the words that have letters which only look like those of their alphabet, outside of code: an array of
    (line_index, token, normalized_token, token_start, token_end, replacements), at most `most`, which a screen is to show; all if None.

    A word counts if it has a Cyrillic letter itself, or is a single letter in a part of a line that has one.
    """

    @F.arrow_udf(_WARNING)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(batches):
            words = [_odd_words(x, most) for x in texts]
            line, token, plain, start, end, pairs = zip(*(w for of in words for w in of)) if any(words) else ((),) * 6
            replaced = lists([len(x) for x in pairs], **{"from": pa.array([x for of in pairs for x, _ in of], pa.string()), "to": pa.array([y for of in pairs for _, y in of], pa.string())})
            places = {name: pa.array(values, pa.int32()) for name, values in (("line_index", line), ("token_start", start), ("token_end", end))}
            yield lists(
                [len(of) for of in words], line_index=places["line_index"], token=pa.array(token, pa.string()), normalized_token=pa.array(plain, pa.string()),
                token_start=places["token_start"], token_end=places["token_end"], replacements=replaced,
            )

    # texts without a Cyrillic letter are not looked at: they are empty for the function
    rows = df.withColumn("__text", nfc(column))
    return rows.withColumn(name, found(F.when(F.col("__text").rlike(_CYRILLIC), F.col("__text")).otherwise(""))).drop("__text")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else html.unescape(x) for x in s])


@F.pandas_udf(T.StringType())
def _unescaped_closed(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _CLOSED.sub(lambda m: html.unescape(m[0]), x) for x in s])


# Tags that end a line, and the length of what is shown.
_LINE_TAGS = r"(?i)<\s*br\s*/?\s*>|</\s*(?:p|tr|li|div|h[1-6])\s*>"
MOST_SHOWN = 4000


def html_text(c: Column, output_format: Column | None = None, most: int | None = MOST_SHOWN, open_references: bool = True) -> Column:
    """Readable text of content: markup of the html format (which null stands for) is taken out, other formats stay as they are.

    A line ends where a tag says so, other tags are blanks; blanks are one space
    within a line and none at its ends. most: characters that are shown, all if
    None. open_references: whether a character
    reference counts without its semicolon too, as in HTML5 (`&amp` but not `&am`).
    """
    text = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, _LINE_TAGS, "\n"), "<[^>]+>", " ")
    shown = F.coalesce((_unescaped if open_references else _unescaped_closed)(F.when(bare.contains("&"), bare)), bare)
    for pattern, to in ((r"[ \t]*\n[ \t]*", "\n"), (r"[ \t]+", " ")):
        shown = F.regexp_replace(shown, pattern, to)
    marked = F.lit(True) if output_format is None else F.lower(strip(output_format)) == "html"
    whole = F.when(marked, strip(shown)).otherwise(text)
    return whole if most is None else F.left(whole, F.lit(most))


def first_table(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<table\b.*?</table>", 0)


# Tags of a cleaned table, the attributes that they keep, and the range of those.
TABLE_TAGS, TABLE_SPANS, SPAN_RANGE = ("table", "thead", "tbody", "tr", "th", "td", "br"), ("rowspan", "colspan"), (1, 200)
_TABLE = re.compile(r"<table\b.*?</table>", re.I | re.S)
#: A comment, an end tag or a tag with its attributes, or text; a "<" that begins nothing is text.
_MARKUP = re.compile(r"""<!--.*?-->|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>|(?P<text>[^<]+|<)""", re.I | re.S)
_SPAN = re.compile(rf"""(?<![\w-])({'|'.join(TABLE_SPANS)})\s*=\s*["']?\s*(\d+)\s*(?:["'\s/]|$)""", re.I)


def clean_table(raw: str | None) -> str | None:
    """The first whole table of a text with safe markup only; null without one.

    What is open is a path of tags; an end tag cuts it at the last tag of its
    name and closes all behind the cut.
    """
    whole = _TABLE.search(raw or "")
    if whole is None:
        return None
    out, path = [], ""
    ends = lambda part: [f"</{x}>" for x in part.strip("/;").split(";/")[::-1]] if part else []
    for m in _MARKUP.finditer(whole[0]):
        if m["text"]:
            out.append(html.escape(html.unescape(m["text"])))
        tag = (m["tag"] or "").lower()
        if tag not in TABLE_TAGS:
            continue
        if m["end"]:
            cut = path.rfind(f"/{tag};")
            if cut >= 0:
                out += ends(path[cut:])
                path = path[:cut]
        else:
            spans = [f' {name.lower()}="{min(max(int(n), SPAN_RANGE[0]), SPAN_RANGE[1])}"' for name, n in _SPAN.findall(m["attrs"])] if tag != "br" else []
            out.append(f"<{tag}{''.join(spans)}>")
            path += f"/{tag};" if tag != "br" else ""
    return "".join(out + ends(path))


@F.pandas_udf(T.StringType())
def sanitised_table(s: pd.Series) -> pd.Series:
    return s.map(clean_table)


def formula_candidates(c: Column) -> Column:
    raw = strip(c)
    no_double = strip(F.regexp_replace(raw, r"(?s)\A\$\$(.*)\$\$\z", "$1"))
    plain = strip(F.regexp_replace(no_double, r"(?s)\A\$(.*)\$\z", "$1"))
    forms = F.array(raw, no_double, plain, F.regexp_replace(plain, r"\n", r"\\\\"), F.regexp_replace(plain, r"\s*\n\s*", " "))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def class_label(c: Column) -> Column:
    name = F.translate(c, "_", " ")
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def stretchable(c: Column) -> dict[str, Column]:
    text = F.coalesce(c, F.lit(""))
    spaces = F.length(text) - F.length(F.translate(text, " ", ""))
    return {"spaces": spaces, "glyphs": F.greatest(F.lit(0), F.length(text) - 1), "combining": text.rlike(r"\p{M}")}


def line_height(output_format: Column) -> Column:
    return F.when(output_format == "latex", 1.1).when(output_format == "html", 1.02).otherwise(1.08)


def has_markdown_table(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?m)^[ \t]*\|.*\|[ \t]*\r?\n[ \t]*\|[ \t:|-]*-[ \t:|-]*\|[ \t]*$")


def odd_fences(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?m)^[ \t]*(?:```|~~~)")) % 2 == 1


def unbalanced_braces(c: Column) -> Column:
    """Braces of LaTeX that do not pair up, where a backslash takes the next character."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)\\.", "")
    marks = F.regexp_replace(plain, r"[^{}]", "")
    depth = F.aggregate(
        F.split(marks, ""),
        F.struct(F.lit(0).alias("d"), F.lit(False).alias("bad")),
        lambda a, ch: F.struct((a["d"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("d"), (a["bad"] | ((ch == "}") & (a["d"] == 0))).alias("bad")),
    )
    return (depth["d"] != 0) | depth["bad"]
