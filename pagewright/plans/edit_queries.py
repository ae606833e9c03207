"""Edits by hand: places by height, dragged and swapped boxes, markup shorthands, prompt sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import orders
from .registry import query
from .views import frame

_IDS = "(SELECT page_id, list(layout_id ORDER BY reading_order) AS ids FROM {d_layouts} GROUP BY page_id)"


def _ids(spark, sf):
    rows = frame(spark, sf, "d_layouts").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("reading_order", "layout_id"))).alias("s"))
    return rows.select("page_id", F.transform("s", lambda x: x["layout_id"]).alias("ids"))


@query("guessed_orders", "SELECT page_id, coalesce(min(reading_order) FILTER ((y1 + y2) / 2 > 0.5), count(*) + 1) AS place FROM {d_layouts} GROUP BY page_id")
def guessed_orders(spark, sf):
    """The order that a box whose middle is halfway down would take."""
    return frame(spark, sf, "d_layouts").groupBy("page_id").agg(orders.guessed_by_height(F.lit(0.5)).alias("place"))


@query("compacted_after_removal", "SELECT layout_id, CASE WHEN reading_order > 2 THEN reading_order - 1 ELSE reading_order END AS new_order, reading_order > 2 AS shifted FROM {d_layouts} WHERE reading_order <> 2")
def compacted_after_removal(spark, sf):
    o = F.col("reading_order")
    return frame(spark, sf, "d_layouts").where(o != 2).select("layout_id", orders.closed_up(o, 2).alias("new_order"), (o > 2).alias("shifted"))


@query("dragged_orders", f"SELECT page_id, list_concat(list_concat(ids[2:3], ids[1:1]), ids[4:]) AS ids FROM {_IDS} WHERE len(ids) >= 3")
def dragged_orders(spark, sf):
    """The first box is dropped behind the third."""
    rows = _ids(spark, sf).where(F.size("ids") >= 3)
    return rows.select("page_id", orders.dragged(F.col("ids"), F.col("ids")[0], F.col("ids")[2]).alias("ids"))


@query("swapped_orders", f"SELECT page_id, CASE WHEN len(ids) = 1 THEN ids ELSE list_concat(list_concat(ids[len(ids):], ids[2:len(ids) - 1]), ids[1:1]) END AS ids FROM {_IDS}")
def swapped_orders(spark, sf):
    """The first box changes places with the last, which is what a place beyond it means."""
    return _ids(spark, sf).select("page_id", orders.swapped(F.col("ids"), F.col("ids")[0], 99).alias("ids"))


@query("script_marks", r"SELECT layout_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?i)<sup\s*/>([^\s<]+)', '<sup>\1</sup>', 'g'), '(?i)<sup\s*/>', '<sup></sup>', 'g'), '(?i)<sub\s*/>([^\s<]+)', '<sub>\1</sub>', 'g'), '(?i)<sub\s*/>', '<sub></sub>', 'g') AS text FROM {d_outputs}")
def script_marks(spark, sf):
    return frame(spark, sf, "d_outputs").select("layout_id", markup.script_tags(F.col("content")).alias("text"))


_ATTRIBUTE = r'<(\w+) (\w+)="([^"]*)"'


@query(
    "table_attributes",
    rf"""SELECT layout_id, n, CASE WHEN tag IN ('td', 'th') AND name IN ('colspan', 'rowspan') OR tag IN ('col', 'colgroup') AND name = 'span' THEN CASE WHEN TRY_CAST(v AS BIGINT) BETWEEN 1 AND 1000 THEN v END WHEN tag = 'th' AND name = 'scope' AND v IN ('row', 'col', 'rowgroup', 'colgroup') THEN v END AS value
FROM (SELECT layout_id, n, lower(regexp_extract(t, '{_ATTRIBUTE}', 1)) AS tag, lower(regexp_extract(t, '{_ATTRIBUTE}', 2)) AS name, lower(trim(regexp_extract(t, '{_ATTRIBUTE}', 3))) AS v FROM (SELECT layout_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS t FROM (SELECT layout_id, regexp_extract_all(content, '{_ATTRIBUTE}') AS l FROM {{d_outputs}})))""",
)
def table_attributes(spark, sf):
    """What is kept of each tag's first attribute, where that has a value."""
    tags = frame(spark, sf, "d_outputs").select("layout_id", F.posexplode(F.regexp_extract_all("content", F.lit(_ATTRIBUTE), F.lit(0))).alias("n", "t"))
    part = lambda i: F.regexp_extract("t", _ATTRIBUTE, i)
    return tags.select("layout_id", F.col("n").cast("long").alias("n"), markup.table_attribute(part(1), part(2), part(3)).alias("value"))


@query("inline_math", r"SELECT layout_id, len(list_filter(regexp_extract_all(regexp_replace(regexp_replace(content, '(?s)\\.', '__', 'g'), '[$]{{2,}}', '__', 'g'), '[$]([^$]*)[$]', 1), lambda x: regexp_matches(x, '\S'))) > 0 AS has_math FROM {d_outputs}")
def inline_math(spark, sf):
    return frame(spark, sf, "d_outputs").select("layout_id", markup.has_inline_math(F.col("content")).alias("has_math"))


@query("prompt_sheet", """SELECT string_agg(concat('## ', cls, chr(10), '- format: ', f, chr(10), CASE WHEN f = 'skip' THEN 'not sent' ELSE concat('Transcribe the ', replace(cls, '_', ' '), ' as ', f, '.') END), chr(10) ORDER BY n) AS sheet
FROM (SELECT n, cls, CASE cls WHEN 'table' THEN 'html' WHEN 'formula' THEN 'latex' WHEN 'picture' THEN 'skip' ELSE 'markdown' END AS f FROM (VALUES (1, 'section_header'), (2, 'text'), (3, 'list_item'), (4, 'table'), (5, 'picture'), (6, 'picture_text'), (7, 'caption'), (8, 'footnote'), (9, 'formula'), (10, 'page_header'), (11, 'page_footer')) AS c(n, cls))""")
def prompt_sheet(spark, sf):
    """One text of the prompts of all classes, in their order."""
    from ..sources.providers import prompt_sheet as sheet

    return sheet(spark, "Transcribe the {class_rule} as {format_rule}.")
