"""Geometry of boxes: overlaps, pixels, connectors, levels and edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .registry import query
from .views import frame

_PAIR = """SELECT a.page_id, a.layout_id AS id_a, b.layout_id AS id_b, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
CASE WHEN least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0 THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) ELSE 0 END AS i,
(a.x2 - a.x1) * (a.y2 - a.y1) AS ra, (b.x2 - b.x1) * (b.y2 - b.y1) AS rb FROM {d_layouts} a JOIN {d_layouts} b ON a.page_id = b.page_id AND a.layout_id < b.layout_id"""


def _pairs(spark, sf):
    boxes = frame(spark, sf, "d_layouts").select("page_id", "layout_id", "x1", "y1", "x2", "y2")
    a = boxes.select("page_id", F.col("layout_id").alias("id_a"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    b = boxes.select("page_id", F.col("layout_id").alias("id_b"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, "page_id").where("id_a < id_b")


@query("box_overlaps", f"SELECT page_id, id_a, id_b, round(CASE WHEN i > 0 THEN i / (ra + rb - i) ELSE 0 END, 9) AS iou, round(CASE WHEN least(ra, rb) > 0 THEN i / least(ra, rb) ELSE 0 END, 9) AS of_smaller, ax1 < bx2 AND ax2 > bx1 AND ay1 < by2 AND ay2 > by1 AS crosses FROM ({_PAIR}) WHERE i > 0")
def box_overlaps(spark, sf):
    a, b = G.box("a"), G.box("b")
    out = _pairs(spark, sf).where(G.intersection(a, b) > 0)
    return out.select("page_id", "id_a", "id_b", F.round(G.iou(a, b), 9).alias("iou"), F.round(G.overlap_of_smaller(a, b), 9).alias("of_smaller"), G.rects_cross(a, b).alias("crosses"))


@query(
    "layout_items",
    """SELECT layout_id, x1, y1, x2, y2, round(x2 - x1, 9) AS width, round(y2 - y1, 9) AS height, round((x1 + x2) / 2, 9) AS center_x, round((y1 + y2) / 2, 9) AS center_y,
CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'empty box' END AS error FROM {d_layouts}""",
)
def layout_items(spark, sf):
    items = G.item_columns(G.box())
    items = {k: F.round(c, 9) if k not in ("x1", "y1", "x2", "y2") else c for k, c in items.items()}
    return frame(spark, sf, "d_layouts").select("layout_id", *[c.alias(k) for k, c in items.items()], G.box_error(G.box()).alias("error"))


@query(
    "box_pixels",
    """SELECT layout_id, CAST(l AS BIGINT) AS "left", CAST(t AS BIGINT) AS top, CAST(greatest(l + 1, r) AS BIGINT) AS "right", CAST(greatest(t + 1, b) AS BIGINT) AS bottom
FROM (SELECT layout_id, least(round_even(x1 * 997, 0), 996) AS l, least(round_even(y1 * 1409, 0), 1408) AS t, round_even(x2 * 997, 0) AS r, round_even(y2 * 1409, 0) AS b FROM {d_layouts})""",
)
def box_pixels(spark, sf):
    return frame(spark, sf, "d_layouts").select("layout_id", *[c.alias(k) for k, c in G.pixels(G.box(), 997, 1409).items()])


@query(
    "connectors",
    f"""SELECT id_a, id_b, round(CASE WHEN ax2 < bx1 THEN ax2 WHEN bx2 < ax1 THEN ax1 ELSE (greatest(ax1, bx1) + least(ax2, bx2)) / 2 END, 9) AS from_x,
round(CASE WHEN ax2 < bx1 THEN bx1 WHEN bx2 < ax1 THEN bx2 ELSE (greatest(ax1, bx1) + least(ax2, bx2)) / 2 END, 9) AS to_x,
round(CASE WHEN ay2 < by1 THEN ay2 WHEN by2 < ay1 THEN ay1 ELSE (greatest(ay1, by1) + least(ay2, by2)) / 2 END, 9) AS from_y,
round(CASE WHEN ay2 < by1 THEN by1 WHEN by2 < ay1 THEN by2 ELSE (greatest(ay1, by1) + least(ay2, by2)) / 2 END, 9) AS to_y FROM ({_PAIR})""",
)
def connectors(spark, sf):
    return _pairs(spark, sf).select("id_a", "id_b", *[F.round(c, 9).alias(k) for k, c in G.connector(G.box("a"), G.box("b")).items()])


@query(
    "heading_levels",
    """WITH h AS (SELECT *, y2 - y1 AS h FROM {d_layouts_n}),
b AS (SELECT page_id, coalesce(median(CASE WHEN cls = 'text' AND h > 0 THEN h END), median(CASE WHEN cls IN ('list_item', 'footnote', 'picture_text') AND h > 0 THEN h END),
 median(CASE WHEN cls IN ('caption', 'footnote', 'list_item', 'picture_text', 'page_footer', 'page_header', 'text') AND h > 0 THEN h END), 0) AS base FROM h GROUP BY page_id)
SELECT layout_id, CASE WHEN base <= 0 THEN 3 WHEN h / base >= 2.2 THEN 2 WHEN h / base >= 1.6 THEN 3 ELSE 4 END AS level FROM h JOIN b ON h.page_id = b.page_id WHERE cls = 'section_header'""",
)
def heading_levels(spark, sf):
    """Level of each heading from its height and the page's typical text height."""
    rows = frame(spark, sf, "d_layouts_n").withColumn("h", F.col("y2") - F.col("y1"))
    page = Window.partitionBy("page_id")
    typical = lambda *names: F.median(F.when(F.col("cls").isin(*names) & (F.col("h") > 0), F.col("h"))).over(page)
    rows = rows.withColumn("base", F.coalesce(typical("text"), typical("list_item", "footnote", "picture_text"), typical("caption", "footnote", "list_item", "picture_text", "page_footer", "page_header", "text"), F.lit(0.0)))
    return rows.where("cls = 'section_header'").select("layout_id", G.heading_level(F.try_divide("h", "base"), F.col("base")).alias("level"))


@query(
    "list_indents",
    "SELECT layout_id, CAST(floor((x1 - least_x) / 0.03) AS INT) AS indent FROM (SELECT layout_id, x1, min(x1) OVER (PARTITION BY page_id) AS least_x FROM {d_layouts_n} WHERE cls = 'list_item')",
)
def list_indents(spark, sf):
    items = frame(spark, sf, "d_layouts_n").where("cls = 'list_item'")
    return items.select("layout_id", G.list_indent(F.col("x1"), F.min("x1").over(Window.partitionBy("page_id"))).alias("indent"))


@query(
    "resized_boxes",
    """SELECT layout_id, round(least(least(1.0, greatest(0.0, x1 - 0.02)), x2 - 0.001), 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(least(1.0, greatest(least(1.0, greatest(0.0, y2 + 0.05)), y1 + 0.001)), 4) AS y2 FROM {d_layouts}""",
)
def resized_boxes(spark, sf):
    return frame(spark, sf, "d_layouts").select("layout_id", *[c.alias(k) for k, c in G.resized(G.box(), "sw", -0.02, 0.05).items()])


@query(
    "class_colours",
    """SELECT DISTINCT cls, list_reduce(list_prepend(0, list_transform(string_split(cls, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: (a * 31 + b) % 7) AS colour FROM {d_layouts_n}""",
)
def class_colours(spark, sf):
    """Palette place of a class by a rolling hash of its characters modulo the palette's size."""
    chars = F.filter(F.split("cls", ""), lambda c: c != "")
    return frame(spark, sf, "d_layouts_n").select("cls").distinct().select("cls", F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % 7).alias("colour"))


@query(
    "border_overlaps",
    """WITH e AS (SELECT page_id, layout_id, unnest([1, 2]) AS side, unnest([x1, x2]) AS at, y1 AS lo, y2 AS hi FROM {d_layouts})
SELECT a.page_id, a.layout_id AS id_a, b.layout_id AS id_b, a.side AS side_a, b.side AS side_b, round(a.at, 6) AS at, round(greatest(a.lo, b.lo), 6) AS lo, round(least(a.hi, b.hi), 6) AS hi
FROM e a JOIN e b ON a.page_id = b.page_id AND a.layout_id < b.layout_id AND round(a.at, 6) = round(b.at, 6) WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.001""",
)
def border_overlaps(spark, sf):
    """Vertical edges of different boxes of a page that lie on one line and share a stretch."""
    edges = frame(spark, sf, "d_layouts").select("page_id", "layout_id", F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("x1").alias("at")), F.struct(F.lit(2).alias("side"), F.col("x2").alias("at")))), F.col("y1").alias("lo"), F.col("y2").alias("hi")).withColumn("line", F.round("at", 6))
    a = edges.select("page_id", "line", *[F.col(c).alias(f"a_{c}") for c in ("layout_id", "side", "lo", "hi")])
    b = edges.select("page_id", "line", *[F.col(c).alias(f"b_{c}") for c in ("layout_id", "side", "lo", "hi")])
    both = a.join(b, ["page_id", "line"]).where((F.col("a_layout_id") < F.col("b_layout_id")) & (F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo") >= 0.001))
    return both.select("page_id", F.col("a_layout_id").alias("id_a"), F.col("b_layout_id").alias("id_b"), F.col("a_side").alias("side_a"), F.col("b_side").alias("side_b"), F.col("line").alias("at"), F.round(F.greatest("a_lo", "b_lo"), 6).alias("lo"), F.round(F.least("a_hi", "b_hi"), 6).alias("hi"))
