"""Removal, the event log, rescoring and the benchmark screens' orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import lifecycle, matching
from .registry import query
from .relational_queries import _HARD, hard_page_ids, latest_results, score_grid
from .state_queries import _STATE
from .views import frame

_TABLES = {"pages": "d_pages", "layouts": "d_layouts", "outputs": "d_outputs", "jobs": "d_jobs", "results": "d_results", "bindings": "d_bindings", "duplicates": "d_duplicates", "events": "d_events"}
_GONE = "(SELECT page_id, rel_path FROM {d_pages} WHERE is_missing)"


@query(
    "rows_after_removal",
    f"""WITH g AS {_GONE}, b AS (SELECT layout_id FROM {{d_layouts}} WHERE page_id IN (SELECT page_id FROM g))
SELECT 'pages' AS name, count(*) AS n, count(page_id) AS with_page FROM {{d_pages}} WHERE page_id NOT IN (SELECT page_id FROM g)
UNION ALL SELECT 'layouts', count(*), count(page_id) FROM {{d_layouts}} WHERE page_id NOT IN (SELECT page_id FROM g)
UNION ALL SELECT 'outputs', count(*), count(page_id) FROM {{d_outputs}} WHERE page_id NOT IN (SELECT page_id FROM g)
UNION ALL SELECT 'jobs', count(*), count(page_id) FROM {{d_jobs}} WHERE page_id NOT IN (SELECT page_id FROM g)
UNION ALL SELECT 'results', count(*), count(page_id) FROM {{d_results}} WHERE page_id NOT IN (SELECT page_id FROM g)
UNION ALL SELECT 'bindings', count(*), count(caption_layout_id) FROM {{d_bindings}} WHERE caption_layout_id NOT IN (SELECT layout_id FROM b) AND target_layout_id NOT IN (SELECT layout_id FROM b)
UNION ALL SELECT 'duplicates', count(*), count(canonical_page_id) FROM {{d_duplicates}} WHERE canonical_page_id NOT IN (SELECT page_id FROM g) AND rel_path NOT IN (SELECT rel_path FROM g)
UNION ALL SELECT 'events', count(*), count(*) FILTER (page_id NOT IN (SELECT page_id FROM g)) FROM {{d_events}}""",
)
def rows_after_removal(spark, sf):
    """What is left of each table once all missing pages were removed."""
    tables = {k: frame(spark, sf, v) for k, v in _TABLES.items()}
    left = lifecycle.without_pages(tables, tables["pages"].where("is_missing"))
    out = None
    for name, df in left.items():
        key = {"bindings": "caption_layout_id", "duplicates": "canonical_page_id"}.get(name, "page_id")
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count(key).alias("with_page"))
        out = one if out is None else out.unionByName(one)
    return out


@query("events_as_logged", """SELECT id, concat('{{"page_id":', CAST(page_id AS STRING), ',"note":"', replace(replace(replace(replace(note, 'é', concat(chr(92), 'u00e9')), '—', concat(chr(92), 'u2014')), '😀', concat(chr(92), 'ud83d', chr(92), 'ude00')), chr(34), concat(chr(92), chr(34))), '"}}') AS data_json FROM (SELECT id, page_id, concat(message, CASE id % 3 WHEN 0 THEN ' é — "x"' WHEN 1 THEN ' 😀' ELSE '' END) AS note FROM {d_events})""")
def events_as_logged(spark, sf):
    """Events with their data as compact ASCII JSON."""
    note = F.concat("message", F.when(F.col("id") % 3 == 0, ' é — "x"').when(F.col("id") % 3 == 1, " 😀").otherwise(""))
    rows = frame(spark, sf, "d_events").withColumn("note", note)
    return rows.select("id", lifecycle.ascii_json(F.struct("page_id", "note")).alias("data_json"))


@query(
    "pages_after_events",
    f"""WITH c AS (SELECT CASE WHEN max(id) < 100 THEN 0 ELSE 100 END AS start FROM {{d_events}}), e AS (SELECT *, {_STATE} AS s FROM {{d_events}}, c WHERE id > start AND stage <> 'layout_benchmark' AND page_id > 0),
l AS (SELECT page_id, arg_max(s, id) AS s FROM e WHERE s IS NOT NULL GROUP BY 1)
SELECT p.page_id, CASE WHEN is_missing OR l.s IS NULL THEN status ELSE l.s END AS status, NOT is_missing AND l.s IS NOT NULL AND l.s <> status AS changed FROM {{d_pages}} p LEFT JOIN l ON l.page_id = p.page_id""",
)
def pages_after_events(spark, sf):
    """Pages after the events beyond a cursor at 100."""
    pages = frame(spark, sf, "d_pages").select("page_id", "status", "is_missing")
    return lifecycle.applied_events(pages, frame(spark, sf, "d_events"), 100)[0].select("page_id", "status", "changed")


_ELIGIBLE = "(SELECT page_id FROM {d_pages} WHERE NOT is_missing AND upper(status) IN ('LAYOUT_REVIEWED', 'OCR_EXTRACTING', 'OCR_DONE', 'OCR_FAILED', 'OCR_REVIEWED'))"


@query(
    "rescored_counts",
    f"""SELECT count(*) AS total_rows, count(*) FILTER (r = 'rescored') AS recalculated_rows, count(*) FILTER (r = 'page') AS skipped_no_page, count(*) FILTER (r = 'fingerprint') AS skipped_fingerprint_mismatch, count(*) FILTER (r = 'predictions') AS skipped_no_predictions
FROM (SELECT CASE WHEN p.page_id IS NULL THEN 'page' WHEN r.page_fingerprint <> 'fp-1' THEN 'fingerprint' WHEN q.page_id IS NULL THEN 'predictions' ELSE 'rescored' END AS r FROM {{d_results}} r LEFT JOIN {_ELIGIBLE} p ON p.page_id = r.page_id LEFT JOIN (SELECT DISTINCT page_id, cfg FROM {{d_predictions}}) q ON q.page_id = r.page_id AND q.cfg = r.cfg)""",
)
def rescored_counts(spark, sf):
    """What rescoring stored results comes to: how many are scored anew, and why the others are not."""
    rows = rescorable(frame(spark, sf, "d_results"), _eligible(spark, sf), frame(spark, sf, "d_predictions"))
    n = lambda v: F.count_if(F.col("verdict") == v)
    return rows.agg(F.count("*").alias("total_rows"), n("rescored").alias("recalculated_rows"), n("page").alias("skipped_no_page"), n("fingerprint").alias("skipped_fingerprint_mismatch"), n("predictions").alias("skipped_no_predictions"))


def _eligible(spark, sf):
    live = frame(spark, sf, "d_pages").where(~F.col("is_missing") & N.status_upper(F.col("status")).isin(*N.BENCHMARK_STATUSES))
    return live.select("page_id", F.lit("fp-1").alias("fingerprint"))


def rescorable(results, pages, predictions):
    """Stored results with the first reason that keeps them from being scored again, or rescored."""
    have = predictions.select("page_id", "cfg").distinct().withColumn("have", F.lit(True))
    rows = results.join(pages, "page_id", "left").join(have, ["page_id", "cfg"], "left")
    verdict = F.when(F.col("fingerprint").isNull(), "page").when(F.col("page_fingerprint") != F.col("fingerprint"), "fingerprint").when(F.col("have").isNull(), "predictions").otherwise("rescored")
    return rows.withColumn("verdict", verdict)


@query("rescored_results")
def rescored_results(spark, sf):
    """Results that can be scored again, with their new scores; the matcher has its own SQL in class_average_precision."""
    predictions = frame(spark, sf, "d_predictions")
    rows = rescorable(frame(spark, sf, "d_results"), _eligible(spark, sf), predictions).where("verdict = 'rescored'")
    classes = matching.class_scores(frame(spark, sf, "d_layouts_n"), predictions, ["cfg"])
    scored = matching.page_scores(classes, rows.select("cfg", "page_id").distinct(), ["cfg"])
    return rows.join(scored, ["cfg", "page_id"]).select("result_id", F.round("map50_95", 9).alias("score"))


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, model, image_size, conf, iou ORDER BY updated_at DESC, result_id DESC) AS nth FROM {d_results}) WHERE nth = 1)"
_GRID = f"""SELECT model, image_size, conf, count(*) AS page_count, round(avg(score), 9) AS mean, min(score) AS least, round(sqrt(greatest(0, avg(score * score) - avg(score) ** 2)), 6) AS spread, round(avg(CASE WHEN h.page_id IS NOT NULL THEN score END), 9) AS hard_mean
FROM {_LAST} r LEFT JOIN {_HARD} h ON h.page_id = r.page_id GROUP BY model, image_size, conf"""


def _grid(spark, sf):
    hard = hard_page_ids(frame(spark, sf, "d_layouts_n")).withColumn("hard", F.lit(True))
    return score_grid(latest_results(frame(spark, sf, "d_results")).join(hard, "page_id", "left"), ("model", "image_size", "conf"))


@query("leaderboard_rows", f"SELECT model, image_size, mean, CAST(row_number() OVER (ORDER BY (model = 'model-b' AND image_size = 512) DESC, mean DESC NULLS LAST, spread NULLS LAST, least DESC NULLS LAST, hard_mean DESC NULLS LAST, model, image_size) AS INT) AS place FROM ({_GRID})")
def leaderboard_rows(spark, sf):
    """All settings in the order of the screen while one of them is being run, which comes first."""
    running = (F.col("model") == "model-b") & (F.col("image_size") == 512)
    order = [F.desc(running), F.desc_nulls_last("mean"), F.asc_nulls_last("spread"), F.desc_nulls_last("least"), F.desc_nulls_last("hard_mean"), "model", "image_size"]
    # one row a setting, a bounded grid
    return _grid(spark, sf).select("model", "image_size", "mean", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("best_cells", f"SELECT model, image_size, mean, page_count, conf FROM (SELECT *, row_number() OVER (PARTITION BY model, image_size ORDER BY mean DESC NULLS LAST, page_count DESC, conf) AS n FROM ({_GRID})) WHERE n = 1")
def best_cells(spark, sf):
    """Of the settings in each cell of the heat map the best one: by mean, then pages, then the lower confidence."""
    best = Window.partitionBy("model", "image_size").orderBy(F.desc_nulls_last("mean"), F.desc("page_count"), "conf")
    return _grid(spark, sf).withColumn("n", F.row_number().over(best)).where("n = 1").select("model", "image_size", "mean", "page_count", "conf")


@query("heat_map_rows", f"SELECT model, map_from_entries(list((image_size, mean) ORDER BY image_size)) AS cells FROM (SELECT model, image_size, max(mean) AS mean FROM ({_GRID}) GROUP BY 1, 2) GROUP BY model")
def heat_map_rows(spark, sf):
    """The heat map by rows, with as many sizes as there are."""
    cells = F.array_sort(F.collect_list(F.struct("image_size", "mean")))
    return best_cells(spark, sf).groupBy("model").agg(F.map_from_entries(cells).alias("cells"))
