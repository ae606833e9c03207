"""From a transcript to stored content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import normalise as N
from ..functions import text as T

OTHER_TEXT = ("list_item", "footnote", "picture_text")
MARKDOWN = ("caption", "footnote", "list_item", "picture_text", "page_footer", "page_header", "text")


def post_processed(layouts: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(layout_id, class_name, output_format, content) for boxes that need text.

    A heading gets its level from its height against the page's text, a list item
    its marker and indent, a formula loses its delimiters; then glyphs are folded
    as the format allows.
    """
    page = Window.partitionBy("page_id")
    high = F.col("y2") - F.col("y1")
    typical = lambda *names: F.median(F.when(F.col("cls").isin(*names) & (high > 0), high)).over(page)
    base = F.coalesce(typical("text"), typical(*OTHER_TEXT), typical(*MARKDOWN), F.lit(0.0))
    rows = layouts.select(
        "layout_id", "cls", G.heading_level(F.try_divide(high, base), base).alias("level"), G.list_indent(F.col("x1"), F.coalesce(F.min(F.when(F.col("cls") == "list_item", F.col("x1"))).over(page), F.col("x1"))).alias("indent")
    )
    rows = rows.where(N.requires_text(F.col("cls"))).join(transcripts.select("layout_id", "content"), "layout_id")
    c, cls = F.col("content"), F.col("cls")
    # a function in Python runs for all rows, so others than headings are empty for it
    heading = F.when(cls == "section_header", c)
    shaped = F.when(cls == "section_header", T.with_heading_level(heading, F.col("level"))).when(cls == "list_item", T.list_line(c, F.col("indent"))).when(cls == "formula", T.plain_latex(c)).otherwise(c)
    rows = rows.select("layout_id", "cls", N.expected_format(cls).alias("output_format"), shaped.alias("shaped"))
    return rows.select("layout_id", F.col("cls").alias("class_name"), "output_format", T.normalised_content(F.col("shaped"), F.col("output_format")).alias("content"))
