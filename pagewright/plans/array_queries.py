"""Order-dependent operators over the boxes of a page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import matching, reading_order
from .registry import query
from .views import frame

_IOU = "CASE WHEN least(g.x2, p.x2) - greatest(g.x1, p.x1) > 0 AND least(g.y2, p.y2) - greatest(g.y1, p.y1) > 0 THEN (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1)) / ((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1))) ELSE 0.0 END"
_AP = f"""WITH RECURSIVE th AS (SELECT unnest(range(10)) AS t),
pr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id, cfg, cls ORDER BY coalesce(confidence, 0) DESC, pred_id) AS k FROM {{d_predictions}}),
gt AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY page_id, cls) AS n FROM {{d_layouts_n}}),
cand AS MATERIALIZED (SELECT p.page_id, p.cfg, p.cls, p.k, g.layout_id, {_IOU} AS o FROM pr p JOIN gt g ON g.page_id = p.page_id AND g.cls = p.cls),
arr AS MATERIALIZED (SELECT page_id, cfg, cls, k, list({{{{'o': o, 'g': layout_id}}}} ORDER BY o DESC, layout_id) FILTER (o >= 0.5) AS c FROM cand GROUP BY ALL),
m(page_id, cfg, cls, t, k, used, hit) AS (
 SELECT page_id, cfg, cls, t, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM (SELECT DISTINCT page_id, cfg, cls FROM arr), th
 UNION ALL SELECT page_id, cfg, cls, t, k, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END, b FROM (
  SELECT m.page_id, m.cfg, m.cls, m.t, m.k + 1 AS k, m.used, list_filter(a.c, lambda x: x.o >= (50 + 5 * m.t)::DOUBLE / 100 AND NOT list_contains(m.used, x.g))[1].g AS b
  FROM m JOIN arr a ON a.page_id = m.page_id AND a.cfg = m.cfg AND a.cls = m.cls AND a.k = m.k + 1)),
pts AS (SELECT m.page_id, m.cfg, m.cls, t, k, count(hit) OVER (PARTITION BY m.page_id, m.cfg, m.cls, t ORDER BY k) AS tp FROM m WHERE k > 0),
n AS (SELECT DISTINCT page_id, cls, n FROM gt),
cur AS (SELECT pts.page_id, cfg, pts.cls, t, list({{{{'r': tp::DOUBLE / n, 'p': tp::DOUBLE / k}}}}) AS l FROM pts JOIN n ON n.page_id = pts.page_id AND n.cls = pts.cls GROUP BY ALL),
ap AS (SELECT page_id, cfg, cls, t, list_sum(list_transform(range(101), lambda q: coalesce(list_max(list_transform(list_filter(l, lambda x: x.r >= q::DOUBLE / 100), lambda x: x.p)), 0))) / 101 AS ap FROM cur),
cl AS (SELECT page_id, cls FROM gt UNION SELECT page_id, cls FROM pr), ac AS (SELECT page_id, cls, cfg FROM (SELECT DISTINCT page_id, cls FROM gt), (SELECT DISTINCT cfg FROM pr) UNION SELECT page_id, cls, cfg FROM pr),
sc AS (SELECT ac.cfg, ac.page_id, ac.cls, coalesce(max(CASE WHEN t = 0 THEN ap END), 0) AS ap50, coalesce(sum(ap), 0) / 10 AS ap FROM ac LEFT JOIN ap ON ap.page_id = ac.page_id AND ap.cls = ac.cls AND ap.cfg = ac.cfg GROUP BY ALL)"""


def _classes(spark, sf):
    return matching.class_scores(frame(spark, sf, "d_layouts_n"), frame(spark, sf, "d_predictions"), ["cfg"])


@query("class_average_precision", f"{_AP} SELECT cfg, page_id, cls, round(ap50, 6) AS ap50, round(ap, 6) AS ap FROM sc")
def class_average_precision(spark, sf):
    return _classes(spark, sf).select("cfg", "page_id", "cls", F.round("ap50", 6).alias("ap50"), F.round("ap", 6).alias("ap"))


@query("page_map", f"{_AP} SELECT cfg, page_id, round(avg(ap50), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM sc GROUP BY cfg, page_id")
def page_map(spark, sf):
    classes = _classes(spark, sf)
    pages = frame(spark, sf, "d_layouts_n").select("page_id").distinct().withColumn("cfg", F.explode(F.array(*map(F.lit, range(4)))))
    return matching.page_scores(classes, pages, ["cfg"]).select("cfg", "page_id", F.round("map50", 6).alias("map50"), F.round("map50_95", 6).alias("map50_95"))


@query(
    "predictions_without_overlaps",
    """WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id, cfg ORDER BY coalesce(confidence, 0) DESC, (x2 - x1) * (y2 - y1) DESC, pred_id) AS k FROM {d_predictions}),
f(page_id, cfg, k, kept) AS (SELECT DISTINCT page_id, cfg, 0::BIGINT, []::BIGINT[] FROM r UNION ALL
 SELECT r.page_id, r.cfg, r.k, CASE WHEN EXISTS (SELECT 1 FROM r z WHERE z.page_id = r.page_id AND z.cfg = r.cfg AND list_contains(f.kept, z.k) AND least(z.x2, r.x2) > greatest(z.x1, r.x1) AND least(z.y2, r.y2) > greatest(z.y1, r.y1)
   AND (least(z.x2, r.x2) - greatest(z.x1, r.x1)) * (least(z.y2, r.y2) - greatest(z.y1, r.y1)) / least((z.x2 - z.x1) * (z.y2 - z.y1), (r.x2 - r.x1) * (r.y2 - r.y1)) >= 0.85) THEN f.kept ELSE list_append(f.kept, r.k) END
 FROM f JOIN r ON r.page_id = f.page_id AND r.cfg = f.cfg AND r.k = f.k + 1),
l AS (SELECT page_id, cfg, unnest(kept) AS k FROM (SELECT page_id, cfg, arg_max(kept, k) AS kept FROM f GROUP BY page_id, cfg))
SELECT r.page_id, r.cfg, r.pred_id, r.cls FROM r JOIN l ON l.page_id = r.page_id AND l.cfg = r.cfg AND l.k = r.k""",
)
def predictions_without_overlaps(spark, sf):
    return matching.without_overlaps(frame(spark, sf, "d_predictions"), ["page_id", "cfg"]).select("page_id", "cfg", "pred_id", "cls")


def _orders(spark, sf, *parts):
    pages = frame(spark, sf, "d_pages").select("page_id", N.order_mode(F.col("order_mode")).alias("mode"))
    return reading_order.page_orders(frame(spark, sf, "d_layouts"), pages, parts)


@query("reading_orders")
def reading_orders(spark, sf):
    return _orders(spark, sf, "inferred", "ids").select("page_id", "mode", "inferred", "ids")


@query("insertion_places")
def insertion_places(spark, sf):
    return _orders(spark, sf, "place").select("page_id", "mode", "place")


@query(
    "single_orders",
    "SELECT l.page_id, list(layout_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, layout_id) AS ids FROM {d_layouts} l JOIN {d_pages} p ON p.page_id = l.page_id WHERE p.order_mode = 'Single_Column' GROUP BY l.page_id",
)
def single_orders(spark, sf):
    return _orders(spark, sf, "ids").where("mode = 'single'").select("page_id", "ids")


@query(
    "page_gutters",
    """SELECT page_id, round(least(0.65, greatest(0.35, (median(c) FILTER (c < 0.5) + median(c) FILTER (c >= 0.5)) / 2)), 9) AS gutter FROM (SELECT page_id, (x1 + x2) / 2 AS c FROM {d_layouts}) GROUP BY page_id
HAVING count(*) >= 4 AND count(*) FILTER (c < 0.5) >= 2 AND count(*) FILTER (c >= 0.5) >= 2 AND median(c) FILTER (c >= 0.5) - median(c) FILTER (c < 0.5) >= 0.28 AND count(*) FILTER (c BETWEEN 0.45 AND 0.55) <= greatest(1, floor(0.2 * count(*)))""",
)
def page_gutters(spark, sf):
    """Where the halves of a two-page scan meet, by conditional medians."""
    c = F.col("c")
    left, right = F.median(F.when(c < 0.5, c)), F.median(F.when(c >= 0.5, c))
    pages = frame(spark, sf, "d_layouts").select("page_id", ((F.col("x1") + F.col("x2")) / 2).alias("c")).groupBy("page_id")
    rows = pages.agg(F.count("*").alias("n"), F.count_if(c < 0.5).alias("nl"), F.count_if(c >= 0.5).alias("nr"), left.alias("l"), right.alias("r"), F.count_if(c.between(0.45, 0.55)).alias("m"))
    rows = rows.where("n >= 4 AND nl >= 2 AND nr >= 2 AND r - l >= 0.28D AND m <= greatest(1, floor(0.2D * n))")
    return rows.select("page_id", F.round(F.least(F.lit(0.65), F.greatest(F.lit(0.35), (F.col("l") + F.col("r")) / 2)), 9).alias("gutter"))


@query("compacted_orders", "SELECT layout_id, row_number() OVER (PARTITION BY page_id ORDER BY reading_order, layout_id) AS new_order FROM {d_layouts} WHERE layout_id IN (SELECT layout_id FROM {d_outputs})")
def compacted_orders(spark, sf):
    """Orders without gaps after the boxes that have no output were removed."""
    kept = frame(spark, sf, "d_layouts").join(frame(spark, sf, "d_outputs").select("layout_id"), "layout_id", "left_semi")
    return kept.select("layout_id", F.row_number().over(Window.partitionBy("page_id").orderBy("reading_order", "layout_id")).cast("long").alias("new_order"))


@query(
    "moved_orders",
    "SELECT layout_id, CASE WHEN reading_order = f THEN least(t, n) WHEN f < least(t, n) AND reading_order > f AND reading_order <= least(t, n) THEN reading_order - 1 WHEN f > t AND reading_order >= t AND reading_order < f THEN reading_order + 1 ELSE reading_order END AS new_order FROM (SELECT *, max(reading_order) OVER (PARTITION BY page_id) AS n, 1 AS f, 3 AS t FROM {d_layouts})",
)
def moved_orders(spark, sf):
    """The first box of each page moves to the third place, or the last there is."""
    from ..operators.orders import moved

    return moved(frame(spark, sf, "d_layouts"), "page_id", "reading_order", 1, 3).select("layout_id", "new_order")


@query("shifted_orders", "SELECT layout_id, CASE WHEN reading_order >= 2 THEN reading_order + 1 ELSE reading_order END AS new_order FROM {d_layouts}")
def shifted_orders(spark, sf):
    from ..operators.orders import shifted

    return frame(spark, sf, "d_layouts").select("layout_id", shifted(F.col("reading_order"), 2).alias("new_order"))


@query("applied_orders", "SELECT page_id, layout_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, layout_id) AS new_order, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, layout_id) <> reading_order AS changed FROM {d_layouts}")
def applied_orders(spark, sf):
    """An explicit list of ids for each page, here from top to bottom, becomes its order."""
    from ..operators.orders import applied

    layouts = frame(spark, sf, "d_layouts")
    wanted = layouts.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x1", "layout_id"))), lambda s: s["layout_id"]).alias("ids"))
    return applied(layouts, wanted).select("page_id", "layout_id", F.col("new_order").cast("long").alias("new_order"), "changed")


@query("contiguous_orders", "SELECT page_id, count(*) = max(reading_order) AND count(*) = count(DISTINCT reading_order) AND min(reading_order) = 1 AS contiguous FROM {d_layouts} WHERE layout_id IN (SELECT layout_id FROM {d_outputs}) GROUP BY page_id")
def contiguous_orders(spark, sf):
    o = F.col("reading_order")
    """Whether the boxes that have an output are numbered from 1 without gaps."""
    kept = frame(spark, sf, "d_layouts").join(frame(spark, sf, "d_outputs").select("layout_id"), "layout_id", "left_semi")
    return kept.groupBy("page_id").agg(((F.count("*") == F.max(o)) & (F.count("*") == F.count_distinct(o)) & (F.min(o) == 1)).alias("contiguous"))


@query("page_fingerprints", """SELECT page_id, sha256(string_agg(printf('%d|%s|%.6f|%.6f|%.6f|%.6f', reading_order, cls, x1, y1, x2, y2), ';' ORDER BY reading_order, layout_id)) AS fingerprint FROM {d_layouts_n} WHERE cls <> 'picture_text' GROUP BY page_id""")
def page_fingerprints(spark, sf):
    rows = frame(spark, sf, "d_layouts_n").where("cls <> 'picture_text'")
    part = F.format_string("%d|%s|%.6f|%.6f|%.6f|%.6f", "reading_order", "cls", "x1", "y1", "x2", "y2")
    parts = F.array_sort(F.collect_list(F.struct("reading_order", "layout_id", part.alias("s"))))
    return rows.groupBy("page_id").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["s"]), ";"), 256).alias("fingerprint"))


@query("column_counts")
def column_counts(spark, sf):
    """Columns of each page and whether it looks like one of several."""
    pages = frame(spark, sf, "d_layouts").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("layout_id", "x1", "y1", "x2", "y2"))).alias("b"))
    return pages.select("page_id", reading_order.column_look("b").alias("c")).select("page_id", "c.*")
