"""Projections and predicates: canonical names, states, settings, formats and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as N
from .registry import query
from .views import frame

_CORE = "regexp_replace(translate(lower(trim(class_name)), '-/', '__'), '\\s+', '_', 'g')"


@query(
    "class_names",
    rf"""SELECT layout_id, c AS class_core, CASE c WHEN 'title' THEN 'section_header' WHEN 'list_item' THEN 'text' ELSE c END AS class_detected,
CASE c WHEN 'title' THEN 'section_header' ELSE c END AS class_persisted, CASE WHEN c <> 'picture_text' THEN CASE c WHEN 'title' THEN 'section_header' ELSE c END END AS class_benchmark,
regexp_replace(lower(trim(class_name)), '[\s/_-]+', '_', 'g') AS class_loose, concat(upper(substr(replace(c, '_', ' '), 1, 1)), substr(replace(c, '_', ' '), 2)) AS label
FROM (SELECT layout_id, class_name, {_CORE} AS c FROM {{d_layouts}})""",
)
def class_names(spark, sf):
    from ..functions.text import class_label

    c = F.col("class_name")
    return frame(spark, sf, "d_layouts").select(
        "layout_id", N.class_core(c).alias("class_core"), N.class_detected(c).alias("class_detected"), N.class_persisted(c).alias("class_persisted"),
        N.class_benchmark(c).alias("class_benchmark"), N.class_loose(c).alias("class_loose"), class_label(N.class_core(c)).alias("label"),
    )


@query(
    "page_settings",
    """SELECT page_id, CASE WHEN m = 'single-column' THEN 'single' WHEN m IN ('single', 'multi-column', 'two-page') THEN m ELSE 'auto' END AS order_mode,
upper(status) AS status_key, lower(status) AS api_status FROM (SELECT page_id, status, replace(lower(trim(order_mode)), '_', '-') AS m FROM {d_pages})""",
)
def page_settings(spark, sf):
    return frame(spark, sf, "d_pages").select("page_id", N.order_mode(F.col("order_mode")).alias("order_mode"), N.status_upper(F.col("status")).alias("status_key"), N.status_lower(F.col("status")).alias("api_status"))


@query(
    "orientations",
    """SELECT layout_id, CASE WHEN lower(trim(orientation)) IN ('v', 'ver', 'vertical') THEN 'vertical' ELSE 'horizontal' END AS orientation,
CASE WHEN x2 > x1 AND y2 > y1 AND (y2 - y1) / (x2 - x1) >= 2 THEN 'vertical' ELSE 'horizontal' END AS inferred,
CASE WHEN lower(trim(orientation)) IN ('v', 'vertical') THEN true WHEN lower(trim(orientation)) IN ('h', 'horizontal') THEN false
     ELSE x2 > x1 AND y2 > y1 AND (y2 - y1) / (x2 - x1) >= 2 END AS effective_vertical FROM {d_layouts}""",
)
def orientations(spark, sf):
    from ..functions import geometry as G

    o = F.col("orientation")
    return frame(spark, sf, "d_layouts").select("layout_id", N.orientation(o).alias("orientation"), G.inferred_orientation(G.box()).alias("inferred"), G.effective_vertical(o, G.box()).alias("effective_vertical"))


@query(
    "output_rules",
    """SELECT layout_id, CASE WHEN s IN ('ok', 'manual', 'failed', 'skip') THEN s ELSE 'ok' END AS extraction_status, f AS expected_format, f <> 'skip' AS requires_text,
f <> 'skip' AND output_format = f AND class_name = cls AS matches, f = 'markdown' AND g = f AND output_format = f AS can_preserve
FROM (SELECT o.layout_id, lower(trim(o.extraction_status)) AS s, o.class_name, o.output_format, l.cls,
CASE l.cls WHEN 'table' THEN 'html' WHEN 'formula' THEN 'latex' WHEN 'picture' THEN 'skip' ELSE 'markdown' END AS f,
CASE o.class_name WHEN 'table' THEN 'html' WHEN 'formula' THEN 'latex' WHEN 'picture' THEN 'skip' ELSE 'markdown' END AS g
FROM {d_outputs} o JOIN {d_layouts_n} l ON l.layout_id = o.layout_id)""",
)
def output_rules(spark, sf):
    outputs = frame(spark, sf, "d_outputs").select("layout_id", F.col("class_name").alias("output_class"), "output_format", "extraction_status")
    both = outputs.join(frame(spark, sf, "d_layouts_n").select("layout_id", "cls"), "layout_id")
    o, f, c = F.col("output_class"), F.col("output_format"), F.col("cls")
    return both.select(
        "layout_id", N.extraction_status(F.col("extraction_status")).alias("extraction_status"), N.expected_format(c).alias("expected_format"), N.requires_text(c).alias("requires_text"),
        N.output_matches(o, f, c).alias("matches"), N.can_preserve(o, c, f).alias("can_preserve"),
    )


@query(
    "config_keys",
    "SELECT cfg, printf('%s|%d|%.6f|%.6f', model, image_size, conf, iou) AS config_key, printf('%s | imgsz=%d conf=%.2f', model, image_size, conf) AS label FROM {d_configs}",
)
def config_keys(spark, sf):
    m, s, c, i = (F.col(x) for x in ("model", "image_size", "conf", "iou"))
    return frame(spark, sf, "d_configs").select("cfg", N.config_key(m, s, c, i).alias("config_key"), N.config_label(m, s, c).alias("label"))


@query(
    "key_aliases",
    "SELECT c_custkey, CASE WHEN length(k) <= 8 THEN k ELSE concat(substr(k, 1, 4), '...', right(k, 4)) END AS alias FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN substr(c_name, 1, 7) ELSE c_name END AS k FROM customer)",
)
def key_aliases(spark, sf):
    k = F.when(F.col("c_custkey") % 3 == 0, F.substring("c_name", 1, 7)).otherwise(F.col("c_name"))
    return frame(spark, sf, "customer").select("c_custkey", N.key_alias(k).alias("alias"))


@query(
    "stage_names",
    """SELECT id, CASE stage WHEN 'layout_detect' THEN 'layout detection' WHEN 'layout_benchmark' THEN 'layout benchmark' WHEN 'ocr_extract' THEN 'OCR extraction'
WHEN 'ocr_review' THEN 'OCR review' ELSE replace(stage, '_', ' ') END AS stage_name FROM {d_events}""",
)
def stage_names(spark, sf):
    return frame(spark, sf, "d_events").select("id", N.stage_name(F.col("stage")).alias("stage_name"))


@query(
    "completion_messages",
    """SELECT job_id, CASE WHEN stage = 'ocr_extract' THEN concat('OCR extraction completed: extracted ', e, ', skipped ', s, '.')
WHEN stage = 'layout_detect' THEN 'layout detection completed.' WHEN stage = 'layout_benchmark' THEN 'layout benchmark completed.' ELSE concat(replace(stage, '_', ' '), ' completed.') END AS message
FROM (SELECT job_id, stage, coalesce(TRY_CAST(json_extract_string(result_json, '$.extracted_count') AS BIGINT), 0) AS e, coalesce(TRY_CAST(json_extract_string(result_json, '$.skipped_count') AS BIGINT), 0) AS s
FROM {d_jobs} WHERE status = 'completed')""",
)
def completion_messages(spark, sf):
    jobs = frame(spark, sf, "d_jobs").where("status = 'completed'")
    result = N.json_object(F.col("result_json"), "extracted_count long, skipped_count long")
    counts = F.format_string("OCR extraction completed: extracted %d, skipped %d.", F.coalesce(result["extracted_count"], F.lit(0)), F.coalesce(result["skipped_count"], F.lit(0)))
    return jobs.select("job_id", F.when(F.col("stage") == "ocr_extract", counts).otherwise(F.concat(N.stage_name(F.col("stage")), F.lit(" completed."))).alias("message"))


@query(
    "bounded_ints",
    "SELECT job_id, least(greatest(coalesce(TRY_CAST(CASE WHEN job_id % 3 = 0 THEN stage ELSE CAST(job_id * 7 - 300 AS STRING) END AS BIGINT), 5), 1), 200) AS n FROM {d_jobs}",
)
def bounded_ints(spark, sf):
    raw = F.when(F.col("job_id") % 3 == 0, F.col("stage")).otherwise((F.col("job_id") * 7 - 300).cast("string"))
    return frame(spark, sf, "d_jobs").select("job_id", N.bounded_int(raw, 5, 1, 200).alias("n"))


@query(
    "error_kinds",
    """SELECT event_id, m LIKE '%quota%' OR m LIKE '%rate limit%' OR m LIKE '%resource_exhausted%' OR m LIKE '%429%' AS quota,
m LIKE '%per day%' OR m LIKE '%perday%' OR m LIKE '%daily%' AS daily, m LIKE '%500%' OR m LIKE '%502%' OR m LIKE '%503%' OR m LIKE '%504%' OR m LIKE '%unavailable%' OR m LIKE '%internal error%' AS server
FROM (SELECT event_id, lower(CASE event_id % 5 WHEN 0 THEN 'HTTP 429 Rate Limit' WHEN 1 THEN 'Quota exceeded per day' WHEN 2 THEN 'HTTP 503 Unavailable' WHEN 3 THEN concat('code ', CAST(event_id AS STRING)) ELSE '' END) AS m FROM events)""",
)
def error_kinds(spark, sf):
    k = F.col("event_id") % 5
    m = F.when(k == 0, "HTTP 429 Rate Limit").when(k == 1, "Quota exceeded per day").when(k == 2, "HTTP 503 Unavailable").when(k == 3, F.concat(F.lit("code "), F.col("event_id").cast("string"))).otherwise("")
    return frame(spark, sf, "events").select("event_id", N.holds_any(m, N.QUOTA_TERMS).alias("quota"), N.holds_any(m, N.DAILY_TERMS).alias("daily"), N.holds_any(m, N.SERVER_TERMS).alias("server"))


@query("batch_payloads", "SELECT job_id, coalesce(CASE WHEN payload_json LIKE '{{%' THEN lower(trim(json_extract_string(payload_json, '$.trigger'))) = 'batch_ocr' END, false) AS is_batch FROM {d_jobs}")
def batch_payloads(spark, sf):
    return frame(spark, sf, "d_jobs").select("job_id", N.is_batch_payload(F.col("payload_json")).alias("is_batch"))


@query(
    "json_payloads",
    """SELECT job_id, CASE WHEN payload_json LIKE '{{%' THEN json_extract_string(payload_json, '$.trigger') END AS trigger,
CASE WHEN payload_json LIKE '{{%' THEN CAST(json_extract(payload_json, '$.batch_total_layouts') AS BIGINT) END AS total, payload_json LIKE '{{%' IS TRUE AS is_object FROM {d_jobs}""",
)
def json_payloads(spark, sf):
    p = N.json_object(F.col("payload_json"), "trigger string, batch_total_layouts long")
    is_object = F.coalesce(F.ltrim("payload_json").startswith("{"), F.lit(False))
    return frame(spark, sf, "d_jobs").select("job_id", p["trigger"].alias("trigger"), p["batch_total_layouts"].alias("total"), is_object.alias("is_object"))


@query(
    "safe_paths",
    "SELECT page_id, p, p <> '' AND p NOT LIKE '/%' AND NOT list_contains(string_split(p, '/'), '..') AS is_safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('/', rel_path) WHEN 1 THEN concat('../', rel_path) WHEN 2 THEN replace(rel_path, '/', '/../') ELSE rel_path END AS p FROM {d_pages})",
)
def safe_paths(spark, sf):
    k, r = F.col("page_id") % 4, F.col("rel_path")
    p = F.when(k == 0, F.concat(F.lit("/"), r)).when(k == 1, F.concat(F.lit("../"), r)).when(k == 2, F.replace(r, F.lit("/"), F.lit("/../"))).otherwise(r)
    return frame(spark, sf, "d_pages").select("page_id", p.alias("p")).withColumn("is_safe", N.is_safe_path(F.col("p")))


@query("eligible_pages", "SELECT page_id, status FROM {d_pages} WHERE NOT is_missing AND upper(status) IN ('LAYOUT_REVIEWED', 'OCR_EXTRACTING', 'OCR_DONE', 'OCR_FAILED', 'OCR_REVIEWED')")
def eligible_pages(spark, sf):
    return frame(spark, sf, "d_pages").where(~F.col("is_missing") & N.status_upper(F.col("status")).isin(*N.BENCHMARK_STATUSES)).select("page_id", "status")


@query("hard_pages", "SELECT page_id, max(CASE WHEN cls IN ('table', 'formula', 'caption', 'picture', 'footnote', 'list_item') THEN 1 ELSE 0 END) = 1 AS hard_class, count(*) >= 8 AS many, count(*) AS n_layouts FROM {d_layouts_n} GROUP BY page_id HAVING max(CASE WHEN cls IN ('table', 'formula', 'caption', 'picture', 'footnote', 'list_item') THEN 1 ELSE 0 END) = 1 OR count(*) >= 8")
def hard_pages(spark, sf):
    pages = frame(spark, sf, "d_layouts_n").groupBy("page_id").agg(F.bool_or(F.col("cls").isin(*N.HARD_CLASSES)).alias("hard_class"), (F.count("*") >= 8).alias("many"), F.count("*").alias("n_layouts"))
    return pages.where("hard_class OR many")


@query("list_rows", "SELECT job_id, list_filter(l, lambda x, i: x > 0 AND list_position(l, x) = i) AS ids FROM (SELECT job_id, list_reverse(CAST(json_extract(payload_json, '$.layout_ids') AS BIGINT[])) AS l FROM {d_jobs} WHERE payload_json LIKE '{{%')")
def list_rows(spark, sf):
    """Positive ids, each once where it is first seen; parsed from the JSON list, which is read from its end here so that it is not in order."""
    ids = N.json_object(F.col("payload_json"), "layout_ids array<long>")["layout_ids"]
    return frame(spark, sf, "d_jobs").where(F.col("payload_json").startswith("{")).select("job_id", F.array_distinct(F.filter(F.reverse(ids), lambda x: x > 0)).alias("ids"))
