"""Rules of the review screens, selection quotas, settings and migrations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import normalise as N
from ..operators import matching
from .registry import query
from .text_queries import _NORMAL
from .views import frame

LINE_CLASSES = ("text", "section_header", "list_item", "caption", "footnote", "page_header", "page_footer", "picture_text")


@query("stage_membership", """SELECT count(*) FILTER (NOT is_missing AND s = 'new') AS discovery, count(*) FILTER (NOT is_missing AND s = 'layout_detected') AS layout_review, count(*) FILTER (NOT is_missing AND s = 'layout_reviewed') AS ocr_extraction,
count(*) FILTER (NOT is_missing AND s = 'ocr_done') AS ocr_review, count(*) FILTER (NOT is_missing AND s = 'ocr_reviewed') AS finalization, count(*) FILTER (s IN ('layout_detected', 'layout_reviewed', 'ocr_done', 'ocr_reviewed')) AS seen_layout_review,
count(*) FILTER (s IN ('layout_reviewed', 'ocr_done', 'ocr_reviewed')) AS seen_extraction, count(*) FILTER (s IN ('ocr_done', 'ocr_reviewed')) AS seen_review FROM (SELECT is_missing, lower(status) AS s FROM {d_pages})""")
def stage_membership(spark, sf):
    s, live = N.status_lower(F.col("status")), ~F.col("is_missing")
    pending = {"discovery": "new", "layout_review": "layout_detected", "ocr_extraction": "layout_reviewed", "ocr_review": "ocr_done", "finalization": "ocr_reviewed"}
    seen = {"seen_layout_review": ("layout_detected", "layout_reviewed", "ocr_done", "ocr_reviewed"), "seen_extraction": ("layout_reviewed", "ocr_done", "ocr_reviewed"), "seen_review": ("ocr_done", "ocr_reviewed")}
    return frame(spark, sf, "d_pages").agg(*[F.count_if(live & (s == v)).alias(k) for k, v in pending.items()], *[F.count_if(s.isin(*v)).alias(k) for k, v in seen.items()])


@query("natural_page_keys", "SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(rel_path), '(\\d+|\\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN concat(lpad(CAST(length(CAST(CAST(x AS BIGINT) AS STRING)) AS STRING), 10, '0'), CAST(CAST(x AS BIGINT) AS STRING)) ELSE x END), '') AS key FROM {d_pages}")
def natural_page_keys(spark, sf):
    """Keys by which names sort in natural order: without regard to case, runs of digits by value."""
    from ..operators.orders import natural_key

    return frame(spark, sf, "d_pages").select("page_id", natural_key(F.col("rel_path")).alias("key"))


@query("client_leaderboard", "SELECT model, image_size, round(avg(score), 9) AS mean, min(score) AS least FROM {d_results} GROUP BY model, image_size ORDER BY mean DESC, least DESC, model, image_size LIMIT 3")
def client_leaderboard(spark, sf):
    grid = frame(spark, sf, "d_results").where("image_size >= 32").groupBy("model", "image_size").agg(F.round(F.avg("score"), 9).alias("mean"), F.min("score").alias("least"))
    return grid.orderBy(F.desc("mean"), F.desc("least"), "model", "image_size").limit(3)


@query("draft_changes", """SELECT layout_id, CASE WHEN d_class <> cls OR d_orientation <> orientation OR round(d_x1, 4) <> round(x1, 4) THEN 'blocking' WHEN d_order <> reading_order THEN 'order only' ELSE 'none' END AS change
FROM (SELECT layout_id, cls, reading_order, x1, 'horizontal' AS orientation, CASE WHEN seed % 11 = 0 THEN 'table' ELSE cls END AS d_class, CASE WHEN seed % 13 = 0 THEN 'vertical' ELSE 'horizontal' END AS d_orientation, CASE WHEN seed % 17 = 0 THEN x1 + 0.25 WHEN seed % 2 = 0 THEN x1 + 0.000001 ELSE x1 END AS d_x1, CASE WHEN seed % 3 = 0 THEN reading_order + 1 ELSE reading_order END AS d_order FROM {d_layouts_n})""")
def draft_changes(spark, sf):
    """What a draft changes against the stored box: a change of order alone does not block a reorder."""
    s = F.col("seed")
    base = frame(spark, sf, "d_layouts_n").select("layout_id", "cls", "reading_order", "x1", F.lit("horizontal").alias("orientation"))
    draft = frame(spark, sf, "d_layouts_n").select(
        "layout_id", F.when(s % 11 == 0, "table").otherwise(F.col("cls")).alias("d_class"), F.when(s % 13 == 0, "vertical").otherwise("horizontal").alias("d_orientation"),
        F.when(s % 17 == 0, F.col("x1") + 0.25).when(s % 2 == 0, F.col("x1") + 0.000001).otherwise(F.col("x1")).alias("d_x1"), F.when(s % 3 == 0, F.col("reading_order") + 1).otherwise(F.col("reading_order")).alias("d_order"),
    )
    both = base.join(draft, "layout_id", "left")
    blocking = (F.col("d_class") != F.col("cls")) | (F.col("d_orientation") != F.col("orientation")) | (F.round("d_x1", 4) != F.round("x1", 4))
    return both.select("layout_id", F.when(blocking, "blocking").when(F.col("d_order") != F.col("reading_order"), "order only").otherwise("none").alias("change"))


@query("line_flows", """SELECT o.layout_id, r AS line_review, CASE WHEN r AND o.output_format = 'markdown' AND (lower(trim(l.orientation)) IN ('v', 'vertical') OR lower(trim(l.orientation)) NOT IN ('h', 'horizontal') AND l.x2 > l.x1 AND l.y2 > l.y1 AND (l.y2 - l.y1) / (l.x2 - l.x1) >= 2) THEN 'vertical' ELSE 'horizontal' END AS flow,
CASE o.class_name WHEN 'picture' THEN 1 WHEN 'picture_text' THEN 3 ELSE 2 END AS layer
FROM (SELECT *, output_format <> 'skip' AND (class_name = 'formula' AND output_format = 'latex' OR class_name IN ('text', 'section_header', 'list_item', 'caption', 'footnote', 'page_header', 'page_footer', 'picture_text')) AS r FROM {d_outputs}) o JOIN {d_layouts} l ON l.layout_id = o.layout_id""")
def line_flows(spark, sf):
    o = frame(spark, sf, "d_outputs").select("layout_id", "class_name", "output_format")
    rows = o.join(frame(spark, sf, "d_layouts").select("layout_id", "orientation", "x1", "y1", "x2", "y2"), "layout_id")
    c, f = F.col("class_name"), F.col("output_format")
    review = (f != "skip") & ((c == "formula") & (f == "latex") | c.isin(*LINE_CLASSES))
    vertical = review & (f == "markdown") & G.effective_vertical(F.col("orientation"), G.box())
    return rows.select("layout_id", review.alias("line_review"), F.when(vertical, "vertical").otherwise("horizontal").alias("flow"), F.when(c == "picture", 1).when(c == "picture_text", 3).otherwise(2).alias("layer"))


@query("line_bands", """SELECT layout_id, k AS line, round(y1 + (y2 - y1) * k / n, 9) AS top, round(y1 + (y2 - y1) * (k + 1) / n, 9) AS bottom, round(greatest(y1, y1 + (y2 - y1) * k / n - (y2 - y1) / n * 0.2), 9) AS crop_top, round(least(y2, y1 + (y2 - y1) * (k + 1) / n + (y2 - y1) / n * 0.2), 9) AS crop_bottom
FROM (SELECT layout_id, y1, y2, n, unnest(range(n)) AS k FROM (SELECT layout_id, y1, y2, 1 + seed % 4 AS n FROM {d_layouts}))""")
def line_bands(spark, sf):
    """Equal bands of a box for its lines, with a margin that stays within the box."""
    rows = frame(spark, sf, "d_layouts").select("layout_id", "y1", "y2", (1 + F.col("seed") % 4).alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    high = F.col("y2") - F.col("y1")
    top, bottom = F.col("y1") + high * F.col("k") / F.col("n"), F.col("y1") + high * (F.col("k") + 1) / F.col("n")
    margin = high / F.col("n") * 0.2
    return rows.select("layout_id", F.col("k").alias("line"), F.round(top, 9).alias("top"), F.round(bottom, 9).alias("bottom"), F.round(F.greatest("y1", top - margin), 9).alias("crop_top"), F.round(F.least("y2", bottom + margin), 9).alias("crop_bottom"))


@query("line_offsets", "SELECT layout_id, n_lines, CASE WHEN n_lines > 1 THEN length(split_part(content, chr(10), 1)) + 1 END AS second_line_at FROM (SELECT layout_id, content, len(string_split(content, chr(10))) AS n_lines FROM {d_outputs})")
def line_offsets(spark, sf):
    lines = F.split("content", "\n", -1)
    n = F.size(lines)
    return frame(spark, sf, "d_outputs").select("layout_id", n.cast("long").alias("n_lines"), F.when(n > 1, F.length(lines[0]) + 1).cast("long").alias("second_line_at"))


@query("approved_lines", "SELECT layout_id, list_sort(list_distinct(list_filter([seed % 7, seed % 3, -1, seed % 3, 99], lambda x: x >= 0 AND x < n))) AS approved, list_min(list_filter(range(n), lambda x: NOT list_contains([seed % 7, seed % 3], x))) AS first_open FROM (SELECT layout_id, seed, CAST(1 + seed % 5 AS BIGINT) AS n FROM {d_layouts})")
def approved_lines(spark, sf):
    """Approved line numbers within the text, each once, and the first that is not approved."""
    rows = frame(spark, sf, "d_layouts").select("layout_id", (1 + F.col("seed") % 5).alias("n"), F.array(F.col("seed") % 7, F.col("seed") % 3, F.lit(-1).cast("long"), F.col("seed") % 3, F.lit(99).cast("long")).alias("raw"))
    rows = rows.withColumn("approved", F.array_sort(F.array_distinct(F.filter("raw", lambda x: (x >= 0) & (x < F.col("n"))))))
    return rows.select("layout_id", "approved", F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.col("approved"))).alias("first_open"))


@query("font_percentiles", "SELECT page_id, round(quantile_cont(y2 - y1, 0.75), 9) AS p75 FROM {d_layouts} GROUP BY page_id")
def font_percentiles(spark, sf):
    return frame(spark, sf, "d_layouts").groupBy("page_id").agg(F.round(F.percentile(F.col("y2") - F.col("y1"), F.lit(0.75)), 9).alias("p75"))


@query("crop_boxes", """SELECT layout_id, CAST(l AS BIGINT) AS "left", CAST(t AS BIGINT) AS top, CAST(greatest(l + 1, r) - l AS BIGINT) AS wide, CAST(greatest(t + 1, b) - t AS BIGINT) AS high, lower(trim(orientation)) IN ('v', 'ver', 'vertical') AS rotate
FROM (SELECT layout_id, orientation, least(round_even(x1 * 1240, 0), 1239) AS l, least(round_even(y1 * 1754, 0), 1753) AS t, round_even(x2 * 1240, 0) AS r, round_even(y2 * 1754, 0) AS b FROM {d_layouts})""")
def crop_boxes(spark, sf):
    p = G.pixels(G.box(), 1240, 1754)
    return frame(spark, sf, "d_layouts").select("layout_id", p["left"].alias("left"), p["top"].alias("top"), (p["right"] - p["left"]).alias("wide"), (p["bottom"] - p["top"]).alias("high"), (N.orientation(F.col("orientation")) == "vertical").alias("rotate"))


@query("normalised_predictions", """SELECT page_id, cfg, pred_id, cls, c AS confidence FROM (SELECT page_id, cfg, pred_id, CASE WHEN cls = 'title' THEN 'section_header' ELSE cls END AS cls, TRY_CAST(CASE pred_id % 4 WHEN 0 THEN 'bad' WHEN 1 THEN '0.5' WHEN 2 THEN NULL ELSE '1' END AS DOUBLE) AS c FROM {d_predictions}) WHERE cls <> 'picture_text' AND cls <> ''""")
def normalised_predictions(spark, sf):
    """Stored predictions as far as they can be used: a bad confidence is none, an excluded or blank class drops the row."""
    k = F.col("pred_id") % 4
    raw = F.when(k == 0, "bad").when(k == 1, "0.5").when(k == 3, "1")
    # the name comes out of an array, below which no filter moves: it would be computed for each of its uses otherwise
    name = F.explode_outer(F.array(N.class_persisted(F.col("cls"))))
    rows = frame(spark, sf, "d_predictions").select("page_id", "cfg", "pred_id", name.alias("cls"), raw.try_cast("double").alias("confidence"))
    return rows.where(~F.col("cls").isin(*N.EXCLUDED, ""))


@query("stored_predictions", """SELECT r.result_id, p.n IS NOT NULL OR r.result_id % 2 = 0 AS valid, coalesce(p.n, 0) AS n FROM {d_results} r LEFT JOIN (SELECT page_id, cfg, count(*) AS n FROM {d_predictions} GROUP BY 1, 2) p ON p.page_id = r.page_id AND p.cfg = r.cfg""")
def stored_predictions(spark, sf):
    """A stored list is valid even when empty; anything else is none. Results without predictions hold an empty list or an object."""
    box = F.struct(F.col("cls").alias("class_name"), "confidence", "x1", "y1", "x2", "y2")
    # in the order of their ids, by which the boxes are numbered page by page: rows lie by page from there on
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("pred_id", box.alias("box")))), lambda r: r["box"])
    lists = frame(spark, sf, "d_predictions").groupBy("page_id", "cfg").agg(F.to_json(boxes).alias("p"))
    # joined by page, a page's lists stay where they are
    lists = lists.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("cfg", "p"))).alias("lists"))
    rows = frame(spark, sf, "d_results").join(lists, "page_id", "left")
    p = F.coalesce(F.col("lists")[F.col("cfg")], F.when(F.col("result_id") % 2 == 0, "[]").otherwise('{"a":1}'))
    is_list = F.coalesce(F.ltrim(p).startswith("["), F.lit(False))
    found = F.from_json(F.when(is_list, p), "array<struct<class_name:string>>")
    return rows.select("result_id", is_list.alias("valid"), F.greatest(F.lit(0), F.coalesce(F.size(found), F.lit(0))).cast("long").alias("n"))


@query("detection_chain")
def detection_chain(spark, sf):
    """Detections as they are stored: class remapped, overlaps dropped, numbered after the boxes that a page has."""
    rows = frame(spark, sf, "d_predictions").withColumn("cls", N.class_detected(F.col("cls")))
    kept = matching.without_overlaps(rows, ["page_id", "cfg"])
    have = frame(spark, sf, "d_layouts").groupBy("page_id").agg(F.max("reading_order").alias("last"))
    place = F.row_number().over(Window.partitionBy("page_id", "cfg").orderBy("y1", "x1", "pred_id"))
    return kept.join(have, "page_id", "left").select("page_id", "cfg", "pred_id", "cls", (F.coalesce("last", F.lit(0)) + place).alias("reading_order"))


@query("migrated_values", """SELECT layout_id, CASE WHEN o IN ('vertical', 'v', 'ver') THEN 'vertical' WHEN o IN ('horizontal', 'h', 'hor') THEN 'horizontal' WHEN y2 - y1 >= (x2 - x1) * 2.0 THEN 'vertical' ELSE 'horizontal' END AS orientation FROM (SELECT *, lower(trim(replace(orientation, '_', '-'))) AS o FROM {d_layouts})""")
def migrated_values(spark, sf):
    """Old orientations, where an unknown one follows from the box without a guard for empty boxes."""
    o = F.translate(F.lower(N.strip(F.col("orientation"))), "_", "-")
    tall = F.col("y2") - F.col("y1") >= (F.col("x2") - F.col("x1")) * 2.0
    out = F.when(o.isin("vertical", "v", "ver"), "vertical").when(o.isin("horizontal", "h", "hor"), "horizontal").when(tall, "vertical").otherwise("horizontal")
    return frame(spark, sf, "d_layouts").select("layout_id", out.alias("orientation"))


@query("migrated_outputs", "SELECT layout_id, s AS extraction_status, CASE WHEN s = 'failed' THEN error_message END AS error_message FROM (SELECT *, CASE WHEN lower(trim(extraction_status)) IN ('ok', 'manual', 'failed', 'skip') THEN lower(trim(extraction_status)) WHEN output_format = 'skip' THEN 'skip' ELSE 'ok' END AS s FROM {d_outputs})")
def migrated_outputs(spark, sf):
    raw = F.lower(N.strip(F.col("extraction_status")))
    s = F.when(raw.isin("ok", "manual", "failed", "skip"), raw).when(F.col("output_format") == "skip", "skip").otherwise("ok")
    return frame(spark, sf, "d_outputs").select("layout_id", s.alias("extraction_status"), F.when(s == "failed", F.col("error_message")).alias("error_message"))


@query("edited_outputs", f"SELECT layout_id, 'manual' AS extraction_status, CAST(NULL AS STRING) AS error_message, {_NORMAL} AS content FROM {{d_outputs}}")
def edited_outputs(spark, sf):
    from ..functions.text import normalised_content

    rows = frame(spark, sf, "d_outputs")
    return rows.select("layout_id", F.lit("manual").alias("extraction_status"), F.lit(None).cast("string").alias("error_message"), normalised_content(F.col("content"), F.col("output_format")).alias("content"))


@query("selection_coverage", """SELECT kind, n, target, n >= target AS met FROM (SELECT kind, count(*) AS n FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'periodical' WHEN 2 THEN 'legal' ELSE 'misc' END AS kind, p_size > 25 AS kept FROM part) WHERE kept GROUP BY kind) JOIN (VALUES ('book', 50), ('periodical', 25), ('legal', 20), ('misc', 5)) AS q(k, target) ON q.k = kind""")
def selection_coverage(spark, sf):
    """Kept candidates of each source type against its target."""
    from ..operators.quotas import TYPES, coverage

    k = F.col("p_partkey") % 4
    rows = frame(spark, sf, "part").select(F.when(k == 0, "book").when(k == 1, "periodical").when(k == 2, "legal").otherwise("misc").alias("kind"), (F.col("p_size") > 25).alias("kept"))
    return coverage(rows, "kind", "kept", TYPES)


@query("crowded_sources", "SELECT p_brand AS document, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_brand HAVING count(*) > 3")
def crowded_sources(spark, sf):
    return frame(spark, sf, "part").where("p_size > 25").groupBy(F.col("p_brand").alias("document")).agg(F.count("*").alias("n")).where("n > 3")


@query("run_status", "SELECT max(id) AS id, arg_max(processed, id) AS processed, arg_max(CASE WHEN total <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, processed::DOUBLE / total)) END, id) AS ratio FROM (SELECT event_id AS id, event_id % 50 AS processed, event_id % 40 AS total FROM events)")
def run_status(spark, sf):
    """The last run and how far it is; a run without tasks is done."""
    runs = frame(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 50).alias("processed"), (F.col("event_id") % 40).alias("total"))
    ratio = F.when(F.col("total") <= 0, 1.0).otherwise(G.clamp(F.col("processed") / F.col("total")))
    return runs.agg(F.max("id").alias("id"), F.max_by("processed", "id").alias("processed"), F.max_by(ratio, "id").alias("ratio"))


@query("foreign_layouts", "SELECT layout_id FROM {d_layouts} WHERE seed % 50 = 0")
def foreign_layouts(spark, sf):
    """Selected boxes that are not of the page they were selected for; here one in fifty was selected for the next page."""
    rows = frame(spark, sf, "d_layouts")
    wanted = rows.select("layout_id", F.when(F.col("seed") % 50 == 0, F.col("page_id") + 1).otherwise(F.col("page_id")).alias("page_id"))
    return wanted.join(rows.select("layout_id", "page_id"), ["layout_id", "page_id"], "left_anti").select("layout_id")


@query("visit_histories", "SELECT user_id, list_slice(list(event_id ORDER BY event_id), -200, -1) AS history FROM events GROUP BY user_id")
def visit_histories(spark, sf):
    """Pages that a user visited in order, the last two hundred."""
    from ..operators.orders import visit_history

    return visit_history(frame(spark, sf, "events"), "user_id", "event_id", "event_id").select("user_id", "history")


@query("visible_boxes", "SELECT layout_id, x1 < 0.7 AND x2 > 0.2 AND y1 < 0.8 AND y2 > 0.3 AS visible, round((x1 - 0.2) / 0.5 * 100, 6) AS left_percent FROM {d_layouts}")
def visible_boxes(spark, sf):
    view = tuple(F.lit(v) for v in (0.2, 0.3, 0.7, 0.8))
    return frame(spark, sf, "d_layouts").select("layout_id", G.rects_cross(G.box(), view).alias("visible"), F.round((F.col("x1") - 0.2) / 0.5 * 100, 6).alias("left_percent"))


@query("constraint_violations", "SELECT 'orders' AS rule, count(*) AS n FROM (SELECT page_id, reading_order FROM {d_layouts} GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'orphans', count(*) FROM {d_layouts} l WHERE NOT EXISTS (SELECT 1 FROM {d_pages} p WHERE p.page_id = l.page_id) UNION ALL SELECT 'first order', count(*) FROM {d_layouts} WHERE reading_order < 1")
def constraint_violations(spark, sf):
    """Keys and references that the tables' declarations promise, as counts of rows that break them."""
    layouts = frame(spark, sf, "d_layouts")
    twice = layouts.groupBy("page_id", "reading_order").count().where("count > 1")
    orphans = layouts.join(frame(spark, sf, "d_pages").select("page_id"), "page_id", "left_anti")
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return count(twice, "orders").unionAll(count(orphans, "orphans")).unionAll(count(layouts.where("reading_order < 1"), "first order"))


@query("post_processed_outputs")
def post_processed_outputs(spark, sf):
    """What a transcript becomes before it is stored: headings, list lines and formulas by class, then glyphs by format."""
    from ..operators.extraction import post_processed

    return post_processed(frame(spark, sf, "d_layouts_n"), frame(spark, sf, "d_outputs"))
