"""Column functions over markup shorthands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalise import strip

# Tags of a table, and the attributes that hold a span.
TABLE_TAGS = ("table", "caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "th", "td", "br", "strong", "em", "b", "i")
SPANS = {"colgroup": ("span",), "col": ("span",), "th": ("colspan", "rowspan"), "td": ("colspan", "rowspan")}
SCOPES = ("row", "col", "rowgroup", "colgroup")


def script_tags(c: Column) -> Column:
    """Empty sup and sub tags take the word behind them."""
    text = F.coalesce(c, F.lit(""))
    for tag in ("sup", "sub"):
        text = F.regexp_replace(text, rf"(?i)<{tag}\s*/>([^\s<]+)", f"<{tag}>$1</{tag}>")
        text = F.regexp_replace(text, rf"(?i)<{tag}\s*/>", f"<{tag}></{tag}>")
    return text


def table_attribute(tag: Column, name: Column, value: Column) -> Column:
    """The value of an attribute that a table may keep: spans from 1 to 1000, scopes of th; else null."""
    tag, name, value = F.lower(strip(tag)), F.lower(strip(name)), strip(value)
    number = F.when(value.rlike(r"^\d+$"), value.try_cast("bigint"))
    spans = F.lit(False)
    for t, names in SPANS.items():
        spans = spans | ((tag == t) & name.isin(*names))
    scope = F.when((tag == "th") & (name == "scope") & F.lower(value).isin(*SCOPES), F.lower(value))
    return F.when(spans, F.when(number.between(1, 1000), number.cast("string"))).otherwise(scope)


def has_inline_math(c: Column) -> Column:
    """Whether a pair of single dollar signs, neither of them escaped, holds anything but white space."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)\\.", "__")
    single = F.regexp_replace(plain, r"\${2,}", "__")
    inner = F.regexp_extract_all(single, F.lit(r"\$([^$]*)\$"), F.lit(1))
    return F.exists(inner, lambda x: strip(x) != "")
