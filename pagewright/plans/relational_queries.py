"""Joins, aggregates, latest-per-key operators, pagination and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normalise as N
from .registry import query
from .views import frame


@query(
    "export_rows",
    """SELECT p.page_id, p.rel_path, l.layout_id, l.reading_order, l.cls, CASE WHEN l.cls <> 'picture' THEN o.content END AS content, CASE WHEN l.cls <> 'picture' THEN o.output_format END AS content_format,
CASE WHEN l.cls = 'caption' THEN t.targets END AS caption_targets
FROM {d_pages} p JOIN {d_layouts_n} l ON l.page_id = p.page_id LEFT JOIN {d_outputs} o ON o.layout_id = l.layout_id
LEFT JOIN (SELECT caption_layout_id, list_sort(list(DISTINCT target_layout_id)) AS targets FROM {d_bindings} GROUP BY 1) t ON t.caption_layout_id = l.layout_id
WHERE NOT p.is_missing AND p.status IN ('OCR_REVIEWED', 'ocr_reviewed')""",
)
def export_rows(spark, sf):
    """Items of exported pages with their output and the targets of captions."""
    pages = frame(spark, sf, "d_pages").where(~F.col("is_missing") & F.col("status").isin(*N.EXPORT_STATUSES)).select("page_id", "rel_path")
    targets = frame(spark, sf, "d_bindings").groupBy("caption_layout_id").agg(F.array_sort(F.collect_set("target_layout_id")).alias("targets"))
    outputs = frame(spark, sf, "d_outputs").select("layout_id", "content", "output_format")
    rows = pages.join(frame(spark, sf, "d_layouts_n").select("page_id", "layout_id", "reading_order", "cls"), "page_id").join(outputs, "layout_id", "left")
    rows = rows.join(targets, F.col("layout_id") == F.col("caption_layout_id"), "left")
    shown = F.col("cls") != "picture"
    return rows.select(
        "page_id", "rel_path", "layout_id", "reading_order", "cls", F.when(shown, F.col("content")).alias("content"), F.when(shown, F.col("output_format")).alias("content_format"),
        F.when(F.col("cls") == "caption", F.col("targets")).alias("caption_targets"),
    )


@query(
    "export_documents",
    """SELECT page_id, rel_path, count(*) AS n_items, list(layout_id ORDER BY reading_order, layout_id) AS layout_ids, list(cls ORDER BY reading_order, layout_id) AS classes
FROM (SELECT p.page_id, p.rel_path, l.layout_id, l.reading_order, l.cls FROM {d_pages} p JOIN {d_layouts_n} l ON l.page_id = p.page_id WHERE NOT p.is_missing AND p.status IN ('OCR_REVIEWED', 'ocr_reviewed')) GROUP BY page_id, rel_path""",
)
def export_documents(spark, sf):
    """One row a page with its items in reading order; the nested form that the JSON lines sink writes."""
    from ..sources.dataset import nested_pages

    pages = nested_pages(frame(spark, sf, "d_pages"), frame(spark, sf, "d_layouts_n"), frame(spark, sf, "d_outputs"), frame(spark, sf, "d_bindings"))
    return pages.select("page_id", F.col("image").alias("rel_path"), F.size("items").cast("long").alias("n_items"), F.col("items.layout_id").alias("layout_ids"), F.col("items.class_name").alias("classes"))


@query(
    "page_bindings",
    "SELECT b.caption_layout_id, b.target_layout_id, c.page_id, p.status FROM {d_bindings} b JOIN {d_layouts} c ON c.layout_id = b.caption_layout_id JOIN {d_layouts} t ON t.layout_id = b.target_layout_id AND t.page_id = c.page_id JOIN {d_pages} p ON p.page_id = c.page_id",
)
def page_bindings(spark, sf):
    layouts = frame(spark, sf, "d_layouts").select("layout_id", "page_id")
    caption = layouts.select(F.col("layout_id").alias("caption_layout_id"), "page_id")
    target = layouts.select(F.col("layout_id").alias("target_layout_id"), "page_id")
    return frame(spark, sf, "d_bindings").join(caption, "caption_layout_id").join(target, ["target_layout_id", "page_id"]).join(frame(spark, sf, "d_pages").select("page_id", "status"), "page_id")


@query(
    "pending_layouts",
    "SELECT l.page_id, count(*) AS n, min(l.layout_id) AS first_layout FROM {d_layouts} l JOIN {d_pages} p ON p.page_id = l.page_id WHERE p.status IN ('layout_reviewed', 'ocr_failed', 'LAYOUT_REVIEWED', 'OCR_FAILED') AND NOT p.is_missing AND NOT EXISTS (SELECT 1 FROM {d_outputs} o WHERE o.layout_id = l.layout_id) GROUP BY l.page_id",
)
def pending_layouts(spark, sf):
    pages = frame(spark, sf, "d_pages").where(F.col("status").isin(*N.BATCH_STATUSES) & ~F.col("is_missing")).select("page_id")
    rows = frame(spark, sf, "d_layouts").select("page_id", "layout_id").join(pages, "page_id", "left_semi").join(frame(spark, sf, "d_outputs").select("layout_id"), "layout_id", "left_anti")
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.min("layout_id").alias("first_layout"))


@query(
    "pending_totals",
    "SELECT count(DISTINCT l.page_id) AS pages, count(*) AS layouts FROM {d_layouts} l JOIN {d_pages} p ON p.page_id = l.page_id WHERE p.status IN ('layout_reviewed', 'ocr_failed', 'LAYOUT_REVIEWED', 'OCR_FAILED') AND NOT p.is_missing AND NOT EXISTS (SELECT 1 FROM {d_outputs} o WHERE o.layout_id = l.layout_id)",
)
def pending_totals(spark, sf):
    return pending_layouts(spark, sf).agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("layouts"))


@query("stale_pages", "SELECT p.page_id FROM {d_pages} p WHERE upper(p.status) IN ('OCR_EXTRACTING', 'LAYOUT_DETECTING') AND NOT EXISTS (SELECT 1 FROM {d_jobs} j WHERE j.page_id = p.page_id AND j.status IN ('queued', 'running'))")
def stale_pages(spark, sf):
    active = frame(spark, sf, "d_jobs").where("status IN ('queued', 'running')").select("page_id")
    return frame(spark, sf, "d_pages").where(N.status_upper(F.col("status")).isin("OCR_EXTRACTING", "LAYOUT_DETECTING")).join(active, "page_id", "left_anti").select("page_id")


@query("recovered_statuses", "SELECT p.page_id, CASE upper(p.status) WHEN 'OCR_EXTRACTING' THEN 'ocr_failed' ELSE 'new' END AS status FROM {d_pages} p WHERE upper(p.status) IN ('OCR_EXTRACTING', 'LAYOUT_DETECTING') AND NOT EXISTS (SELECT 1 FROM {d_jobs} j WHERE j.page_id = p.page_id AND j.status IN ('queued', 'running'))")
def recovered_statuses(spark, sf):
    pages = frame(spark, sf, "d_pages").join(stale_pages(spark, sf), "page_id", "left_semi")
    return pages.select("page_id", F.when(N.status_upper(F.col("status")) == "OCR_EXTRACTING", "ocr_failed").otherwise("new").alias("status"))


@query("recovery_counts", "SELECT count(*) FILTER (status = 'running') AS failed_jobs, count(*) FILTER (status = 'queued') AS queued_jobs FROM {d_jobs}")
def recovery_counts(spark, sf):
    return frame(spark, sf, "d_jobs").agg(F.count_if(F.col("status") == "running").alias("failed_jobs"), F.count_if(F.col("status") == "queued").alias("queued_jobs"))


@query("pages_summary", "SELECT status, count(*) FILTER (NOT is_missing) AS live, count(*) FILTER (is_missing) AS missing FROM {d_pages} GROUP BY status")
def pages_summary(spark, sf):
    return frame(spark, sf, "d_pages").groupBy("status").agg(F.count_if(~F.col("is_missing")).alias("live"), F.count_if("is_missing").alias("missing"))


@query("pipeline_stats", "SELECT (SELECT count(*) FROM {d_pages}) AS pages, (SELECT count(*) FROM {d_pages} WHERE is_missing) AS missing, (SELECT count(*) FROM (SELECT file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY rel_path) AS n FROM {d_scan}) WHERE n > 1) AS duplicates")
def pipeline_stats(spark, sf):
    pages = frame(spark, sf, "d_pages").agg(F.count("*").alias("pages"), F.count_if("is_missing").alias("missing"))
    scan = frame(spark, sf, "d_scan").groupBy("file_hash").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    return pages.withColumn("k", F.lit(1)).join(F.broadcast(scan.withColumn("k", F.lit(1))), "k").drop("k")  # one row each


@query("queued_by_stage", "SELECT stage, count(*) AS n FROM {d_jobs} WHERE status = 'queued' GROUP BY stage")
def queued_by_stage(spark, sf):
    return frame(spark, sf, "d_jobs").where("status = 'queued'").groupBy("stage").agg(F.count("*").alias("n"))


@query("next_orders", "SELECT p.page_id, coalesce(max(l.reading_order), 0) + 1 AS next_order FROM {d_pages} p LEFT JOIN {d_layouts} l ON l.page_id = p.page_id GROUP BY p.page_id")
def next_orders(spark, sf):
    return frame(spark, sf, "d_pages").select("page_id").join(frame(spark, sf, "d_layouts").select("page_id", "reading_order"), "page_id", "left").groupBy("page_id").agg((F.coalesce(F.max("reading_order"), F.lit(0)) + 1).alias("next_order"))


@query("class_counts", "SELECT page_id, cls, count(*) AS n FROM {d_layouts_n} GROUP BY page_id, cls")
def class_counts(spark, sf):
    return frame(spark, sf, "d_layouts_n").groupBy("page_id", "cls").agg(F.count("*").alias("n"))


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, model, image_size, printf('%.6f', conf), printf('%.6f', iou) ORDER BY updated_at DESC, result_id DESC) AS rn FROM {d_results}) WHERE rn = 1)"
_HARD = "(SELECT page_id FROM {d_layouts_n} GROUP BY page_id HAVING max(CASE WHEN cls IN ('table', 'formula', 'caption', 'picture', 'footnote', 'list_item') THEN 1 ELSE 0 END) = 1 OR count(*) >= 8)"


def latest_results(results):
    """The newest result of each page and setting, whatever its fingerprint."""
    key = Window.partitionBy("page_id", "model", "image_size", F.format_string("%.6f", "conf"), F.format_string("%.6f", "iou")).orderBy(F.desc("updated_at"), F.desc("result_id"))
    return results.withColumn("rn", F.row_number().over(key)).where("rn = 1").drop("rn")


@query("latest_results", f"SELECT result_id, page_id, model, image_size, score FROM {_LATEST}")
def latest(spark, sf):
    return latest_results(frame(spark, sf, "d_results")).select("result_id", "page_id", "model", "image_size", "score")


@query(
    "leaderboard_grid",
    f"""SELECT model, image_size, count(*) AS page_count, round(avg(score), 9) AS mean, min(score) AS least, max(score) AS most, round(sqrt(greatest(0, avg(score * score) - avg(score) ** 2)), 6) AS spread,
round(avg(CASE WHEN h.page_id IS NOT NULL THEN score END), 9) AS hard_mean, count(h.page_id) AS hard_count, CAST(row_number() OVER (ORDER BY round(avg(score), 9) DESC, round(avg(CASE WHEN h.page_id IS NOT NULL THEN score END), 9) DESC NULLS LAST, round(sqrt(greatest(0, avg(score * score) - avg(score) ** 2)), 6), min(score) DESC, count(*) DESC, model, image_size) AS INT) AS place
FROM {_LATEST} r LEFT JOIN {_HARD} h ON h.page_id = r.page_id GROUP BY model, image_size""",
)
def leaderboard_grid(spark, sf):
    """Scores of each setting over its pages, with the mean over hard pages, in order of merit."""
    rows = latest_results(frame(spark, sf, "d_results")).join(hard_page_ids(frame(spark, sf, "d_layouts_n")).withColumn("hard", F.lit(True)), "page_id", "left")
    # one row a setting, a bounded grid
    merit = [F.desc("mean"), F.desc_nulls_last("hard_mean"), "spread", F.desc("least"), F.desc("page_count"), "model", "image_size"]
    return score_grid(rows).withColumn("place", F.row_number().over(Window.orderBy(*merit)))


def score_grid(rows, keys=("model", "image_size")):
    """Scores of each setting; rows: score, and hard, true for hard pages."""
    s = F.col("score")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("page_count"), F.round(F.avg(s), 9).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.avg(s * s) - F.avg(s) * F.avg(s))), 6).alias("spread"), F.round(F.avg(F.when(F.col("hard"), s)), 9).alias("hard_mean"), F.count_if("hard").alias("hard_count"),
    )


def hard_page_ids(layouts):
    pages = layouts.groupBy("page_id").agg(F.bool_or(F.col("cls").isin(*N.HARD_CLASSES)).alias("hard"), F.count("*").alias("n"))
    return pages.where("hard OR n >= 8").select("page_id")


@query("best_config", f"SELECT cfg, round(avg(score), 9) AS mean FROM {_LATEST} GROUP BY cfg ORDER BY mean DESC, cfg LIMIT 1")
def best_config(spark, sf):
    means = latest_results(frame(spark, sf, "d_results")).groupBy("cfg").agg(F.round(F.avg("score"), 9).alias("mean"))
    return means.agg(F.max_by(F.struct("cfg", "mean"), F.struct("mean", -F.col("cfg"))).alias("best")).select("best.*")


@query("top_configs", f"SELECT * FROM (SELECT model, image_size, round(avg(score), 9) AS mean FROM {_LATEST} WHERE image_size > 0 AND model <> '' GROUP BY model, image_size) ORDER BY mean DESC, model, image_size LIMIT 3")
def top_configs(spark, sf):
    grid = latest_results(frame(spark, sf, "d_results")).where("image_size > 0 AND model <> ''").groupBy("model", "image_size").agg(F.round(F.avg("score"), 9).alias("mean"))
    return grid.orderBy(F.desc("mean"), "model", "image_size").limit(3)


@query(
    "score_heat_map",
    f"SELECT model, round(avg(score) FILTER (image_size = 512), 9) AS \"512\", round(avg(score) FILTER (image_size = 1024), 9) AS \"1024\" FROM {_LATEST} GROUP BY model",
)
def score_heat_map(spark, sf):
    return latest_results(frame(spark, sf, "d_results")).groupBy("model").pivot("image_size", [512, 1024]).agg(F.round(F.avg("score"), 9))


@query(
    "active_configs",
    "WITH r AS (SELECT model, image_size, cfg IN (0, 3) AS active, score FROM {d_results}) SELECT model, image_size, count(*) AS n FROM r WHERE active OR NOT (SELECT bool_or(active) FROM r) GROUP BY model, image_size",
)
def active_configs(spark, sf):
    """Results of the settings in use, or of all if none of those has any."""
    rows = frame(spark, sf, "d_results").groupBy("model", "image_size", F.col("cfg").isin(0, 3).alias("active")).agg(F.count("*").alias("n"))
    any_ = F.bool_or("active").over(Window.partitionBy(F.lit(1)))  # one row a setting
    return rows.withColumn("any", any_).where("active OR NOT any").groupBy("model", "image_size").agg(F.sum("n").alias("n"))


@query(
    "auto_apply_gate",
    f"""WITH l AS {_LATEST}, m AS (SELECT cfg, round(avg(score), 9) AS mean FROM l GROUP BY cfg), b AS (SELECT * FROM m ORDER BY mean DESC, cfg LIMIT 1), z AS (SELECT mean FROM m WHERE cfg = 1),
n AS (SELECT page_id FROM {{d_pages}} WHERE NOT is_missing AND upper(status) IN ('LAYOUT_REVIEWED', 'OCR_EXTRACTING', 'OCR_DONE', 'OCR_FAILED', 'OCR_REVIEWED') ORDER BY updated_at DESC, page_id LIMIT 2),
s AS (SELECT bool_and(coalesce(x.score, -1) > coalesce(y.score, -1)) AS stable FROM n LEFT JOIN (SELECT * FROM l WHERE cfg = (SELECT cfg FROM b)) x ON x.page_id = n.page_id LEFT JOIN (SELECT * FROM l WHERE cfg = 1) y ON y.page_id = n.page_id)
SELECT b.cfg AS best, CASE WHEN b.cfg = 1 THEN 'already best' WHEN (b.mean - z.mean) / z.mean < 0.025 THEN 'gain too small' WHEN NOT s.stable THEN 'not stable' ELSE 'apply' END AS decision FROM b, z, s""",
)
def auto_apply_gate(spark, sf):
    from ..operators.gates import auto_apply

    eligible = frame(spark, sf, "d_pages").where(~F.col("is_missing") & N.status_upper(F.col("status")).isin(*N.BENCHMARK_STATUSES)).select("page_id", "updated_at")
    return auto_apply(latest_results(frame(spark, sf, "d_results")).select("page_id", "cfg", "score"), eligible, baseline=1)


@query("newest_pages", "SELECT page_id, updated_at FROM {d_pages} ORDER BY updated_at DESC, page_id LIMIT 2")
def newest_pages(spark, sf):
    return frame(spark, sf, "d_pages").select("page_id", "updated_at").orderBy(F.desc("updated_at"), "page_id").limit(2)


@query("canonical_files", "SELECT rel_path, file_hash, n = 1 AS canonical, first_path FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY rel_path) AS n, min(rel_path) OVER (PARTITION BY file_hash) AS first_path FROM {d_scan} WHERE regexp_matches(lower(rel_path), '[^/]\\.(png|jpg|jpeg|webp|tif|tiff)$'))")
def canonical_files(spark, sf):
    from ..sources.inventory import canonical, with_known_suffix

    return canonical(with_known_suffix(frame(spark, sf, "d_scan")))


_FILES = r"(SELECT rel_path, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY rel_path) AS n FROM {d_scan} WHERE regexp_matches(lower(rel_path), '[^/]\.(png|jpg|jpeg|webp|tif|tiff)$'))"
# files whose page is taken over by a file that comes before them, one step after the other
_TURNS = f"""RECURSIVE s AS (SELECT rel_path, file_hash FROM {_FILES} WHERE n = 1),
u(file_hash) AS (SELECT file_hash FROM s WHERE file_hash NOT IN (SELECT file_hash FROM {{d_known}}) UNION SELECT x.file_hash FROM u JOIN s y ON y.file_hash = u.file_hash JOIN {{d_known}} k ON k.rel_path = y.rel_path JOIN s x ON x.file_hash = k.file_hash WHERE y.file_hash < x.file_hash),
m AS (SELECT s.rel_path, s.file_hash, CASE WHEN h.page_id IS NOT NULL AND u.file_hash IS NULL THEN h.page_id WHEN p.page_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s z WHERE z.file_hash = p.file_hash AND z.file_hash < s.file_hash) THEN p.page_id END AS page_id,
 CASE WHEN h.page_id IS NOT NULL AND u.file_hash IS NULL THEN CASE WHEN h.rel_path <> s.rel_path THEN 'renamed' WHEN h.is_missing THEN 'revived' ELSE 'unchanged' END
      WHEN p.page_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s z WHERE z.file_hash = p.file_hash AND z.file_hash < s.file_hash) THEN 'rehashed' ELSE 'inserted' END AS action
 FROM s LEFT JOIN {{d_known}} h ON h.file_hash = s.file_hash LEFT JOIN u ON u.file_hash = s.file_hash LEFT JOIN {{d_known}} p ON p.rel_path = s.rel_path)"""


@query("discovery_upsert", f"WITH {_TURNS} SELECT page_id, rel_path, file_hash, action FROM m UNION ALL SELECT page_id, rel_path, file_hash, 'missing' FROM {{d_known}} WHERE NOT is_missing AND page_id NOT IN (SELECT page_id FROM m WHERE page_id IS NOT NULL)")
def discovery_upsert(spark, sf):
    from ..sources.inventory import canonical, reconcile, with_known_suffix

    scan = canonical(with_known_suffix(frame(spark, sf, "d_scan"))).where("canonical").select("rel_path", "file_hash")
    return reconcile(scan, frame(spark, sf, "d_known"))


@query(
    "duplicate_files",
    f"""WITH {_TURNS}, d AS (SELECT f.rel_path, f.file_hash, m.page_id AS canonical_page_id FROM {_FILES} f JOIN m ON m.file_hash = f.file_hash WHERE f.n > 1)
SELECT rel_path, file_hash, canonical_page_id, true AS active FROM d UNION ALL SELECT rel_path, file_hash, canonical_page_id, false FROM {{d_duplicates}} WHERE rel_path NOT IN (SELECT rel_path FROM d)""",
)
def duplicate_files(spark, sf):
    from ..sources.inventory import canonical, duplicates, reconcile, with_known_suffix

    files = with_known_suffix(frame(spark, sf, "d_scan"))
    matched = reconcile(canonical(files).where("canonical").select("rel_path", "file_hash"), frame(spark, sf, "d_known"))
    return duplicates(files, matched, frame(spark, sf, "d_duplicates"))


@query("rejected_results", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p.page_id IS NULL THEN 'page not eligible' WHEN r.page_fingerprint <> 'fp-1' THEN 'stale fingerprint' ELSE 'rescored' END AS reason
FROM {d_results} r LEFT JOIN (SELECT page_id FROM {d_pages} WHERE NOT is_missing AND upper(status) IN ('LAYOUT_REVIEWED', 'OCR_EXTRACTING', 'OCR_DONE', 'OCR_FAILED', 'OCR_REVIEWED')) p ON p.page_id = r.page_id) GROUP BY reason""")
def rejected_results(spark, sf):
    eligible = frame(spark, sf, "d_pages").where(~F.col("is_missing") & N.status_upper(F.col("status")).isin(*N.BENCHMARK_STATUSES)).select("page_id", F.lit(True).alias("ok"))
    rows = frame(spark, sf, "d_results").select("page_id", "page_fingerprint").join(eligible, "page_id", "left")
    reason = F.when(F.col("ok").isNull(), "page not eligible").when(F.col("page_fingerprint") != "fp-1", "stale fingerprint").otherwise("rescored")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("benchmark_tasks", "SELECT p.page_id, c.cfg FROM {d_pages} p CROSS JOIN {d_configs} c WHERE NOT p.is_missing AND NOT EXISTS (SELECT 1 FROM {d_results} r WHERE r.page_id = p.page_id AND r.cfg = c.cfg AND r.page_fingerprint = 'fp-1')")
def benchmark_tasks(spark, sf):
    """Pages times settings without a score of the page's present fingerprint; settings are a bounded grid."""
    cfgs = [r[0] for r in frame(spark, sf, "d_configs").select("cfg").orderBy("cfg").collect()]
    grid = frame(spark, sf, "d_pages").where("NOT is_missing").select("page_id", F.explode(F.array(*map(F.lit, cfgs))).alias("cfg"))
    return grid.join(frame(spark, sf, "d_results").where("page_fingerprint = 'fp-1'").select("page_id", "cfg"), ["page_id", "cfg"], "left_anti")


_SORTED = "SELECT page_id, rel_path, status FROM {d_pages}"


@query("pages_after_cursor", "SELECT page_id, status, rel_path FROM {d_pages} WHERE status < 'ocr_done' OR (status = 'ocr_done' AND page_id < 400) ORDER BY status DESC, page_id DESC LIMIT 51")
def pages_after_cursor(spark, sf):
    from ..operators.paging import page_after

    return page_after(frame(spark, sf, "d_pages"), "status", "page_id", descending=True, after=("ocr_done", 400), limit=50).select("page_id", "status", "rel_path")


@query("page_cursors", "SELECT page_id, rtrim(translate(to_base64(encode(concat('{{\"s\":\"rel_path\",\"d\":\"asc\",\"v\":\"', rel_path, '\",\"i\":', CAST(page_id AS STRING), '}}'))), '+/', '-_'), '=') AS cursor FROM {d_pages}")
def page_cursors(spark, sf):
    from ..operators.paging import cursor

    return frame(spark, sf, "d_pages").select("page_id", cursor("rel_path", "asc", F.col("rel_path"), F.col("page_id")).alias("cursor"))


@query("decoded_cursors", "SELECT page_id, CASE WHEN page_id > 0 THEN rel_path END AS value, CASE WHEN page_id > 0 THEN page_id END AS id, page_id > 0 AS valid FROM {d_pages}")
def decoded_cursors(spark, sf):
    from ..operators.paging import cursor, decoded

    rows = frame(spark, sf, "d_pages").select("page_id", cursor("rel_path", "asc", F.col("rel_path"), F.col("page_id")).alias("cursor"))
    found = decoded(F.col("cursor"), "rel_path", "asc")
    return rows.select("page_id", found["v"].alias("value"), found["i"].alias("id"), found.isNotNull().alias("valid"))


@query("next_for_review", "SELECT min(page_id) FILTER (page_id > 100) AS after_100, min(page_id) AS first FROM {d_pages} WHERE NOT is_missing AND lower(status) IN ('layout_detected', 'new')")
def next_for_review(spark, sf):
    pages = frame(spark, sf, "d_pages").where(~F.col("is_missing") & N.status_lower(F.col("status")).isin("layout_detected", "new"))
    return pages.agg(F.min(F.when(F.col("page_id") > 100, F.col("page_id"))).alias("after_100"), F.min("page_id").alias("first"))


@query("next_for_qa", "SELECT phase, min(page_id) AS page_id FROM (UNPIVOT (SELECT page_id, qa_bbox_status AS bbox, qa_class_status AS class, qa_order_status AS \"order\", qa_ocr_status AS ocr FROM {d_pages} WHERE NOT is_missing) ON bbox, class, \"order\", ocr INTO NAME phase VALUE s) WHERE s = 'pending' GROUP BY phase")
def next_for_qa(spark, sf):
    pages = frame(spark, sf, "d_pages").where("NOT is_missing")
    long = pages.unpivot("page_id", [F.col(f"qa_{p}_status").alias(p) for p in N.QA_PHASES], "phase", "s")
    return long.where("s = 'pending'").groupBy("phase").agg(F.min("page_id").alias("page_id"))


@query("qa_progress", "SELECT phase, count(*) FILTER (s = 'reviewed') AS reviewed, count(*) AS total FROM (UNPIVOT (SELECT page_id, qa_bbox_status AS bbox, qa_class_status AS class, qa_order_status AS \"order\", qa_ocr_status AS ocr FROM {d_pages}) ON bbox, class, \"order\", ocr INTO NAME phase VALUE s) GROUP BY phase")
def qa_progress(spark, sf):
    long = frame(spark, sf, "d_pages").unpivot("page_id", [F.col(f"qa_{p}_status").alias(p) for p in N.QA_PHASES], "phase", "s")
    return long.groupBy("phase").agg(F.count_if(F.col("s") == "reviewed").alias("reviewed"), F.count("*").alias("total"))


@query("activity_snapshot", """(SELECT 'running' AS kind, job_id AS id, stage AS what FROM {d_jobs} WHERE status = 'running' ORDER BY job_id LIMIT 1) UNION ALL (SELECT 'queued', job_id, stage FROM {d_jobs} WHERE status = 'queued' ORDER BY job_id LIMIT 15)
UNION ALL (SELECT 'event', id, message FROM {d_events} ORDER BY id DESC LIMIT 30)""")
def activity_snapshot(spark, sf):
    jobs, events = frame(spark, sf, "d_jobs"), frame(spark, sf, "d_events")
    row = lambda df, kind, key, what: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(what).alias("what"))
    running = row(jobs.where("status = 'running'").orderBy("job_id").limit(1), "running", "job_id", "stage")
    queued = row(jobs.where("status = 'queued'").orderBy("job_id").limit(15), "queued", "job_id", "stage")
    return running.unionAll(queued).unionAll(row(events.orderBy(F.desc("id")).limit(30), "event", "id", "message"))


@query("events_with_pages", "SELECT e.id, e.stage, e.event_type, p.rel_path FROM {d_events} e LEFT JOIN {d_pages} p ON p.page_id = e.page_id")
def events_with_pages(spark, sf):
    return frame(spark, sf, "d_events").select("id", "stage", "event_type", "page_id").join(frame(spark, sf, "d_pages").select("page_id", "rel_path"), "page_id", "left").drop("page_id")


@query("benchmark_classes", "SELECT page_id, cls, bool_or(src = 'g') AS in_truth, bool_or(src = 'p') AS in_predictions FROM (SELECT page_id, cls, 'g' AS src FROM {d_layouts_n} UNION ALL SELECT page_id, cls, 'p' FROM {d_predictions}) GROUP BY page_id, cls")
def benchmark_classes(spark, sf):
    rows = frame(spark, sf, "d_layouts_n").select("page_id", "cls", F.lit(True).alias("g")).unionAll(frame(spark, sf, "d_predictions").select("page_id", "cls", F.lit(False)))
    return rows.groupBy("page_id", "cls").agg(F.bool_or("g").alias("in_truth"), F.bool_or(~F.col("g")).alias("in_predictions"))


@query("missing_outputs", "SELECT page_id, layout_id FROM {d_layouts_n} WHERE cls <> 'picture' EXCEPT SELECT page_id, layout_id FROM {d_outputs} WHERE lower(trim(extraction_status)) <> 'failed'")
def missing_outputs(spark, sf):
    wanted = frame(spark, sf, "d_layouts_n").where(N.requires_text(F.col("cls"))).select("page_id", "layout_id")
    valid = frame(spark, sf, "d_outputs").where(N.extraction_status(F.col("extraction_status")) != "failed").select("layout_id")
    return wanted.join(valid, "layout_id", "left_anti")


@query("merged_outputs", "SELECT coalesce(l.layout_id, o.layout_id) AS layout_id, l.reading_order, coalesce(o.extraction_status, 'missing') AS state, l.layout_id IS NULL AS orphan FROM {d_layouts} l FULL OUTER JOIN {d_outputs} o ON o.layout_id = l.layout_id")
def merged_outputs(spark, sf):
    layouts = frame(spark, sf, "d_layouts").select("layout_id", "reading_order", F.lit(True).alias("placed"))
    both = layouts.join(frame(spark, sf, "d_outputs").select("layout_id", "extraction_status"), "layout_id", "full")
    return both.select("layout_id", "reading_order", F.coalesce("extraction_status", F.lit("missing")).alias("state"), F.col("placed").isNull().alias("orphan"))
