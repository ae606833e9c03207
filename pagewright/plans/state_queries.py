"""Review rules, state changes, the job queue and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import jobs as J
from ..operators import review as R
from .registry import query
from .views import frame

# what the rules say of each layout's output, by cases: class and format of both sides first, then what follows
_FORMAT = "CASE {} WHEN 'table' THEN 'html' WHEN 'formula' THEN 'latex' WHEN 'picture' THEN 'skip' ELSE 'markdown' END"
_PAIRS = f"""(SELECT l.page_id, l.layout_id, l.cls, l.updated_at, o.layout_id IS NOT NULL AS made, lower(trim(o.extraction_status)) AS s, o.updated_at AS o_at,
{_FORMAT.format('l.cls')} <> 'skip' AS needed, {_FORMAT.format('l.cls')} <> 'skip' AND o.class_name = l.cls AND o.output_format = {_FORMAT.format('l.cls')} AS fits,
o.output_format = 'markdown' AND {_FORMAT.format('o.class_name')} = 'markdown' AND {_FORMAT.format('l.cls')} = 'markdown' AS alike
FROM {{d_layouts_n}} l LEFT JOIN {{d_outputs}} o ON o.layout_id = l.layout_id)"""
_JUDGED = f"""(SELECT page_id, layout_id, cls, needed, CASE WHEN NOT made THEN 'none' WHEN s = 'failed' THEN 'failed' WHEN fits AND updated_at > o_at THEN 'stale' WHEN fits THEN 'ok' WHEN alike THEN 'preserved' ELSE 'mismatch' END AS state FROM {_PAIRS})"""


def _layouts(spark, sf):
    return frame(spark, sf, "d_layouts_n").select("page_id", "layout_id", "reading_order", "cls", "updated_at")


@query("judged_outputs", f"SELECT * FROM {_JUDGED}")
def judged_outputs(spark, sf):
    return R.judged_outputs(_layouts(spark, sf), frame(spark, sf, "d_outputs"))


@query(
    "layout_reviews",
    f"""WITH j AS (SELECT * FROM {_JUDGED}),
u AS (SELECT c.page_id, count(*) AS n FROM {{d_layouts_n}} c WHERE c.cls = 'caption' AND NOT EXISTS (SELECT 1 FROM {{d_bindings}} b JOIN {{d_layouts_n}} t ON t.layout_id = b.target_layout_id WHERE b.caption_layout_id = c.layout_id AND t.page_id = c.page_id AND t.cls IN ('table', 'picture', 'formula')) GROUP BY 1),
p AS (SELECT page_id, count(*) AS n_layouts, count(*) FILTER (state IN ('failed', 'mismatch', 'stale')) AS invalid, count(*) FILTER (needed AND state NOT IN ('ok', 'preserved')) AS missing, count(*) FILTER (needed) AS needed FROM j GROUP BY 1),
v AS (SELECT g.page_id, lower(g.status) AS s, coalesce(n_layouts, 0) AS n_layouts, invalid, missing, needed, CASE WHEN g.is_missing THEN 'page missing' WHEN n_layouts IS NULL THEN 'no layouts' WHEN u.n > 0 THEN 'unbound captions' ELSE 'accepted' END AS verdict
 FROM {{d_pages}} g LEFT JOIN p USING (page_id) LEFT JOIN u USING (page_id))
SELECT page_id, verdict, n_layouts, CASE verdict WHEN 'accepted' THEN invalid END AS invalid, CASE verdict WHEN 'accepted' THEN missing END AS missing,
CASE WHEN verdict = 'accepted' THEN CASE WHEN missing > 0 THEN 'layout_reviewed' WHEN s = 'ocr_reviewed' THEN s WHEN s = 'ocr_done' THEN s WHEN needed = 0 THEN 'layout_reviewed' ELSE 'ocr_done' END END AS next_status FROM v""",
)
def layout_reviews(spark, sf):
    return R.layout_reviews(frame(spark, sf, "d_pages").select("page_id", "status", "is_missing"), _layouts(spark, sf), frame(spark, sf, "d_outputs"), frame(spark, sf, "d_bindings"))


@query(
    "output_reviews",
    f"""WITH s AS (SELECT page_id, count(*) AS n, count(*) FILTER (needed AND made AND s = 'failed') AS failed, count(*) FILTER (needed AND NOT (made AND fits AND s NOT IN ('failed', 'skip'))) AS open FROM {_PAIRS} GROUP BY 1)
SELECT p.page_id, p.status, coalesce(failed, 0) AS failed, coalesce(open, 0) AS open, CASE WHEN p.is_missing THEN 'page missing' WHEN p.status NOT IN ('layout_reviewed', 'ocr_done', 'ocr_reviewed', 'ocr_failed') THEN 'state' WHEN n IS NULL THEN 'no layouts'
WHEN p.page_id NOT IN (SELECT page_id FROM {{d_outputs}}) THEN 'no outputs' WHEN failed > 0 THEN 'failed outputs' WHEN open > 0 THEN 'open outputs' ELSE 'accepted' END AS verdict
FROM {{d_pages}} p LEFT JOIN s ON s.page_id = p.page_id""",
)
def output_reviews(spark, sf):
    return R.output_reviews(frame(spark, sf, "d_pages").select("page_id", "status", "is_missing"), _layouts(spark, sf), frame(spark, sf, "d_outputs"))


@query("binding_targets", "SELECT c.page_id, c.layout_id AS caption_layout_id, coalesce(list_sort(list(DISTINCT t.layout_id) FILTER (t.layout_id IS NOT NULL)), []) AS targets, count(t.layout_id) > 0 AS bound FROM {d_layouts_n} c LEFT JOIN {d_bindings} b ON b.caption_layout_id = c.layout_id LEFT JOIN {d_layouts_n} t ON t.layout_id = b.target_layout_id AND t.page_id = c.page_id AND t.cls IN ('table', 'picture', 'formula') WHERE c.cls = 'caption' GROUP BY c.page_id, c.layout_id")
def binding_targets(spark, sf):
    return R.binding_errors(frame(spark, sf, "d_layouts_n").select("page_id", "layout_id", "cls"), frame(spark, sf, "d_bindings"))


_JOBS = """(SELECT job_id, status, coalesce(nullif(trim(json_extract_string(payload_json, '$.batch_run_id')), ''), concat('legacy:', job_id)) AS run, greatest(ids, coalesce(CAST(json_extract(result_json, '$.progress.total_layouts') AS BIGINT), 0)) AS total,
least(greatest(ids, coalesce(CAST(json_extract(result_json, '$.progress.total_layouts') AS BIGINT), 0)), CASE status WHEN 'completed' THEN greatest(ids, done) WHEN 'failed' THEN done WHEN 'running' THEN coalesce(CAST(json_extract(result_json, '$.progress.processed_layouts') AS BIGINT), 0) ELSE 0 END) AS processed,
coalesce(CAST(json_extract(payload_json, '$.batch_total_layouts') AS BIGINT), 0) AS hint
FROM (SELECT *, len(list_distinct(list_filter(CAST(json_extract(payload_json, '$.layout_ids') AS BIGINT[]), lambda x: x > 0))) AS ids, coalesce(CAST(json_extract(result_json, '$.extracted_count') AS BIGINT), 0) + coalesce(CAST(json_extract(result_json, '$.skipped_count') AS BIGINT), 0) AS done
 FROM {d_jobs} WHERE payload_json LIKE '{{%' AND lower(trim(json_extract_string(payload_json, '$.trigger'))) = 'batch_ocr'))"""


@query("batch_jobs", f"SELECT * FROM {_JOBS}")
def batch_jobs(spark, sf):
    return J.batch_jobs(frame(spark, sf, "d_jobs"))


@query("run_progress", f"SELECT run, count(*) AS jobs, greatest(sum(total), max(hint))::BIGINT AS total, least(greatest(sum(total), max(hint)), sum(processed))::BIGINT AS processed, max(job_id) FILTER (status IN ('queued', 'running')) AS active_job FROM {_JOBS} GROUP BY run")
def run_progress(spark, sf):
    return J.run_progress(frame(spark, sf, "d_jobs"))


@query("active_run", f"SELECT arg_max(run, active_job) AS run, arg_max(total, active_job) AS total, arg_max(processed, active_job) AS processed FROM (SELECT run, greatest(sum(total), max(hint))::BIGINT AS total, least(greatest(sum(total), max(hint)), sum(processed))::BIGINT AS processed, max(job_id) FILTER (status IN ('queued', 'running')) AS active_job FROM {_JOBS} GROUP BY run) WHERE active_job IS NOT NULL")
def active_run(spark, sf):
    runs = J.run_progress(frame(spark, sf, "d_jobs")).where("active_job IS NOT NULL")
    return runs.agg(*[F.max_by(c, "active_job").alias(c) for c in ("run", "total", "processed")])


@query("active_batch_jobs", f"SELECT count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'queued') AS queued FROM {_JOBS}")
def active_batch_jobs(spark, sf):
    return J.batch_jobs(frame(spark, sf, "d_jobs")).agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "queued").alias("queued"))


@query("enqueued_jobs", "SELECT stage, page_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY stage, page_id ORDER BY seq) AS n FROM (SELECT id AS seq, stage, page_id FROM {d_events}) w WHERE NOT EXISTS (SELECT 1 FROM {d_jobs} j WHERE j.stage = w.stage AND j.page_id = w.page_id AND j.status IN ('queued', 'running'))) WHERE n = 1")
def enqueued_jobs(spark, sf):
    return J.enqueued(frame(spark, sf, "d_jobs"), frame(spark, sf, "d_events").select(F.col("id").alias("seq"), "stage", "page_id"))


@query("claimed_job", "SELECT job_id, stage, 'running' AS status, attempts + 1 AS attempts FROM {d_jobs} WHERE status = 'queued' ORDER BY job_id LIMIT 1")
def claimed_job(spark, sf):
    return J.claimed(frame(spark, sf, "d_jobs"))


@query("stopped_jobs", "SELECT job_id, CASE WHEN stage = 'ocr_extract' AND status = 'queued' THEN 'failed' ELSE status END AS status, CASE WHEN stage = 'ocr_extract' AND status = 'queued' THEN 'Stopped by user request.' END AS error, stage = 'ocr_extract' AND status = 'running' AS stop_requested FROM {d_jobs}")
def stopped_jobs(spark, sf):
    return J.stopped(frame(spark, sf, "d_jobs"), "ocr_extract")


_STATE = """CASE WHEN stage = 'layout_detect' AND event_type = 'job_started' THEN 'layout_detecting' WHEN stage = 'layout_detect' AND event_type = 'job_completed' AND NOT skipped THEN 'layout_detected' WHEN stage = 'layout_detect' AND event_type = 'job_failed' THEN 'new'
WHEN stage = 'layout_review' AND event_type = 'manual_review_completed' THEN 'layout_reviewed' WHEN stage = 'ocr_extract' AND event_type = 'job_started' THEN 'ocr_extracting' WHEN stage = 'ocr_extract' AND event_type = 'job_completed' AND NOT skipped THEN 'ocr_done'
WHEN stage = 'ocr_extract' AND event_type = 'job_failed' THEN 'ocr_failed' WHEN stage = 'ocr_review' AND event_type = 'manual_review_completed' THEN 'ocr_reviewed' END"""


@query("event_states", f"SELECT id, {_STATE} AS status FROM {{d_events}}")
def event_states(spark, sf):
    return frame(spark, sf, "d_events").select("id", J.status_of_event(F.col("stage"), F.col("event_type"), F.col("skipped")).alias("status"))


@query("latest_states", f"SELECT page_id, arg_max(status, id) AS status, max(id) AS id FROM (SELECT *, {_STATE} AS status FROM {{d_events}}) WHERE status IS NOT NULL GROUP BY page_id")
def latest_states(spark, sf):
    return J.latest_states(frame(spark, sf, "d_events"))


@query("upserted_results", "SELECT page_id, cfg, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id, cfg ORDER BY updated_at DESC, result_id DESC, score DESC) AS n FROM (SELECT page_id, cfg, score, updated_at, result_id FROM {d_results} UNION ALL SELECT page_id, cfg, score / 2, '2024-02-15', result_id FROM {d_results})) WHERE n = 1")
def upserted_results(spark, sf):
    old = frame(spark, sf, "d_results").select("page_id", "cfg", "score", "updated_at", "result_id")
    new = old.withColumn("score", F.col("score") / 2).withColumn("updated_at", F.lit("2024-02-15"))
    return J.upserted(old, new, ["page_id", "cfg"], ["updated_at", "result_id", "score"]).select("page_id", "cfg", "score")


@query("stage_progress", "SELECT count(*) AS total, count(*) FILTER (lower(status) NOT IN ('new', 'layout_detecting')) AS detected, count(*) FILTER (lower(status) IN ('layout_reviewed', 'ocr_extracting', 'ocr_done', 'ocr_failed', 'ocr_reviewed')) AS reviewed, count(*) FILTER (lower(status) IN ('ocr_done', 'ocr_reviewed')) AS extracted, count(*) FILTER (lower(status) = 'ocr_reviewed') AS accepted FROM {d_pages} WHERE NOT is_missing")
def stage_progress(spark, sf):
    s = N.status_lower(F.col("status"))
    return frame(spark, sf, "d_pages").where("NOT is_missing").agg(
        F.count("*").alias("total"), F.count_if(~s.isin("new", "layout_detecting")).alias("detected"),
        F.count_if(s.isin("layout_reviewed", "ocr_extracting", "ocr_done", "ocr_failed", "ocr_reviewed")).alias("reviewed"), F.count_if(s.isin("ocr_done", "ocr_reviewed")).alias("extracted"), F.count_if(s == "ocr_reviewed").alias("accepted"),
    )


@query("edited_layouts", """SELECT layout_id, abs(nx - x1) > 1e-12 AS bbox_changed, new_class <> cls AS class_changed, new_order <> reading_order AS order_changed, CASE WHEN abs(nx - x1) > 1e-12 OR new_class <> cls THEN '2024-05-01' ELSE updated_at END AS updated_at
FROM (SELECT *, CASE WHEN seed % 3 = 0 THEN x1 / 2 ELSE x1 END AS nx, CASE WHEN seed % 5 = 0 THEN 'text' ELSE cls END AS new_class, CASE WHEN seed % 7 = 0 THEN reading_order + 1 ELSE reading_order END AS new_order FROM {d_layouts_n})""")
def edited_layouts(spark, sf):
    """What an edit changes: only class, orientation and box count as an update, not the order."""
    rows = frame(spark, sf, "d_layouts_n")
    edits = rows.select("layout_id", F.when(F.col("seed") % 3 == 0, F.col("x1") / 2).otherwise(F.col("x1")).alias("nx"), F.when(F.col("seed") % 5 == 0, "text").otherwise(F.col("cls")).alias("new_class"), F.when(F.col("seed") % 7 == 0, F.col("reading_order") + 1).otherwise(F.col("reading_order")).alias("new_order"))
    both = rows.join(edits, "layout_id")
    box, cls = F.abs(F.col("nx") - F.col("x1")) > 1e-12, F.col("new_class") != F.col("cls")
    return both.select("layout_id", box.alias("bbox_changed"), cls.alias("class_changed"), (F.col("new_order") != F.col("reading_order")).alias("order_changed"), F.when(box | cls, "2024-05-01").otherwise(F.col("updated_at")).alias("updated_at"))


@query("removed_page_counts", "SELECT p.page_id, (SELECT count(*) FROM {d_layouts} l WHERE l.page_id = p.page_id) AS layouts, (SELECT count(*) FROM {d_outputs} o WHERE o.page_id = p.page_id) AS outputs, (SELECT count(*) FROM {d_jobs} j WHERE j.page_id = p.page_id) AS jobs FROM {d_pages} p")
def removed_page_counts(spark, sf):
    """Rows that would go with each page if it were removed."""
    pages = frame(spark, sf, "d_pages").select("page_id")
    out = pages
    for name, table in (("layouts", "d_layouts"), ("outputs", "d_outputs"), ("jobs", "d_jobs")):
        out = out.join(frame(spark, sf, table).join(pages, "page_id", "left_semi").groupBy("page_id").agg(F.count("*").alias(name)), "page_id", "left")
    return out.na.fill(0)


@query("line_progress", """SELECT page_id, sum(CASE WHEN needed THEN n_lines ELSE 0 END)::BIGINT AS required, sum(CASE WHEN needed AND NOT resolved THEN 1 ELSE 0 END)::BIGINT AS unresolved FROM (SELECT l.page_id, l.cls <> 'picture' AS needed, o.layout_id IS NOT NULL AND lower(trim(o.extraction_status)) <> 'failed' AS resolved,
CASE WHEN o.content IS NULL THEN 0 ELSE len(string_split(o.content, chr(10))) END AS n_lines FROM {d_layouts_n} l LEFT JOIN {d_outputs} o ON o.layout_id = l.layout_id) GROUP BY page_id""")
def line_progress(spark, sf):
    rows = frame(spark, sf, "d_layouts_n").select("page_id", "layout_id", "cls").join(frame(spark, sf, "d_outputs").select("layout_id", "content", "extraction_status"), "layout_id", "left")
    needed = N.requires_text(F.col("cls"))
    resolved = F.col("content").isNotNull() & (N.extraction_status(F.col("extraction_status")) != "failed")
    lines = F.when(F.col("content").isNull(), 0).otherwise(F.size(F.split("content", "\n", -1)))
    return rows.groupBy("page_id").agg(F.sum(F.when(needed, lines).otherwise(0)).cast("long").alias("required"), F.count_if(needed & ~resolved).alias("unresolved"))


@query("first_pending_outputs", "SELECT page_id, arg_min(layout_id, reading_order * 1000000000000 + layout_id) AS layout_id FROM (SELECT l.page_id, l.layout_id, l.reading_order FROM {d_layouts_n} l LEFT JOIN {d_outputs} o ON o.layout_id = l.layout_id WHERE l.cls <> 'picture' AND (o.layout_id IS NULL OR lower(trim(o.extraction_status)) = 'failed')) GROUP BY page_id")
def first_pending_outputs(spark, sf):
    good = frame(spark, sf, "d_outputs").where(N.extraction_status(F.col("extraction_status")) != "failed").select("layout_id")
    rows = frame(spark, sf, "d_layouts_n").where(N.requires_text(F.col("cls"))).join(good, "layout_id", "left_anti")
    return rows.groupBy("page_id").agg(F.min_by("layout_id", F.struct("reading_order", "layout_id")).alias("layout_id"))


@query("extraction_counts", "SELECT page_id, count(*) FILTER (s = 'ok') AS extracted, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (f = 'skip') AS skipped, coalesce(list_sort(list(layout_id) FILTER (s = 'failed')), []) AS failed_ids FROM (SELECT page_id, layout_id, CASE WHEN lower(trim(extraction_status)) IN ('manual', 'failed', 'skip') THEN lower(trim(extraction_status)) ELSE 'ok' END AS s, output_format AS f FROM {d_outputs}) GROUP BY page_id")
def extraction_counts(spark, sf):
    s = N.extraction_status(F.col("extraction_status"))
    return frame(spark, sf, "d_outputs").groupBy("page_id").agg(
        F.count_if(s == "ok").alias("extracted"), F.count_if(s == "failed").alias("failed"), F.count_if(F.col("output_format") == "skip").alias("skipped"), F.array_sort(F.collect_list(F.when(s == "failed", F.col("layout_id")))).alias("failed_ids")
    )
