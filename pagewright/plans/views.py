"""Engine tables derived from the star-schema tables, in SQL that Spark and DuckDB both run.

Each view is a query over named tables in braces. `frame` gives a view as a
DataFrame; `with_views` writes the same queries as common table expressions, so
a query's oracle reads exactly the rows that the Spark query reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {}

VIEWS["d_layouts"] = """
SELECT page_id, layout_id, reading_order, class_name, seed, x1, y1,
       least(CAST(1 AS DOUBLE), x1+w) AS x2, least(CAST(1 AS DOUBLE), y1+h) AS y2,
       CASE seed % 5 WHEN 0 THEN 'vertical' WHEN 1 THEN ' V ' WHEN 2 THEN 'hor' WHEN 3 THEN 'Horizontal' ELSE 'unknown' END AS orientation,
       concat('2024-01-', lpad(CAST(1 + seed % 28 AS STRING), 2, '0'), 'T00:00:00+00:00') AS updated_at
FROM (SELECT l_orderkey AS page_id, l_orderkey*100+rn AS layout_id, CAST(rn AS INT) AS reading_order,
        CASE l_partkey % 12 WHEN 0 THEN 'Title' WHEN 1 THEN 'Section-Header' WHEN 2 THEN 'Text' WHEN 3 THEN 'List-item'
             WHEN 4 THEN 'Table' WHEN 5 THEN 'Picture' WHEN 6 THEN 'Picture Text' WHEN 7 THEN 'Caption'
             WHEN 8 THEN 'Footnote' WHEN 9 THEN 'Formula' WHEN 10 THEN 'Page-header' WHEN 11 THEN 'Page/Footer' END AS class_name,
        l_partkey AS seed,
        CAST((l_partkey*37)%600 AS DOUBLE)/1000 AS x1,
        CAST((l_partkey*53+l_linenumber*97)%850 AS DOUBLE)/1000 AS y1,
        CAST(60+(CAST(floor(l_quantity) AS BIGINT)*7)%340 AS DOUBLE)/1000 AS w,
        CAST(20+CAST(floor(l_extendedprice) AS BIGINT)%130 AS DOUBLE)/1000 AS h
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,
              l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) AS rn FROM {lineitem}) a) b"""

VIEWS["d_pages"] = """
SELECT o_orderkey AS page_id, concat(o_orderpriority, '/', CAST(o_orderkey AS STRING), '.png') AS rel_path,
       CASE o_orderkey % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'layout_detecting' WHEN 2 THEN 'layout_detected' WHEN 3 THEN 'layout_reviewed'
            WHEN 4 THEN 'ocr_extracting' WHEN 5 THEN 'ocr_done' WHEN 6 THEN 'ocr_reviewed' WHEN 7 THEN 'ocr_failed'
            WHEN 8 THEN 'LAYOUT_REVIEWED' ELSE 'OCR_REVIEWED' END AS status,
       o_orderkey % 17 = 0 AS is_missing,
       CASE o_orderkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'Single_Column' WHEN 2 THEN 'multi-column' ELSE 'TWO_PAGE' END AS order_mode,
       CASE WHEN o_orderkey % 2 = 0 THEN 'reviewed' ELSE 'pending' END AS qa_bbox_status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'reviewed' ELSE 'pending' END AS qa_class_status,
       CASE WHEN o_orderkey % 5 = 0 THEN 'reviewed' ELSE 'pending' END AS qa_order_status,
       CASE WHEN o_orderkey % 7 = 0 THEN 'reviewed' ELSE 'pending' END AS qa_ocr_status,
       concat(substr(CAST(o_orderdate AS STRING), 1, 10), 'T', lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':00:00+00:00') AS created_at,
       concat(substr(CAST(o_orderdate AS STRING), 1, 10), 'T', lpad(CAST((o_orderkey * 7) % 24 AS STRING), 2, '0'), ':30:00+00:00') AS updated_at
FROM {orders}"""

VIEWS["d_layouts_n"] = """
SELECT *, CASE replace(replace(replace(lower(class_name), '-', '_'), '/', '_'), ' ', '_') WHEN 'title' THEN 'section_header'
       ELSE replace(replace(replace(lower(class_name), '-', '_'), '/', '_'), ' ', '_') END AS cls FROM {d_layouts}"""

VIEWS["d_predictions"] = """
SELECT page_id, cfg, layout_id AS pred_id,
       CASE WHEN (seed+cfg)%13=0 THEN 'text' ELSE cls END AS cls,
       CASE WHEN seed%9=0 THEN NULL ELSE CAST((seed*29+cfg*31)%1000 AS DOUBLE)/1000 END AS confidence,
       greatest(CAST(0 AS DOUBLE), x1+d) AS x1, y1, least(CAST(1 AS DOUBLE), x2+d) AS x2, y2
FROM (SELECT l.*, cfg, CAST((seed*11+cfg*17)%60-30 AS DOUBLE)/1000 AS d
      FROM {d_layouts_n} l CROSS JOIN (SELECT 0 AS cfg UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) c
      WHERE (seed+cfg*7)%5<>0) t"""

# Each document is the whole content of one output, the first that is dealt to it; the others have short contents of all kinds.
VIEWS["d_outputs"] = """
SELECT layout_id, page_id, CASE WHEN seed % 11 = 0 THEN 'text' ELSE cls END AS class_name,
       CASE WHEN seed % 19 = 0 THEN 'markdown' WHEN cls = 'table' THEN 'html' WHEN cls = 'formula' THEN 'latex' WHEN cls = 'picture' THEN 'skip' ELSE 'markdown' END AS output_format,
       CASE WHEN body IS NOT NULL THEN concat(CASE seed % 6 WHEN 0 THEN '## ' WHEN 1 THEN '- ' WHEN 2 THEN '12. ' WHEN 3 THEN '$x_1$ ' ELSE '' END, translate(body, CASE WHEN seed % 4 = 0 THEN 'aeo' ELSE '' END, CASE WHEN seed % 4 = 0 THEN 'аео' ELSE '' END))
       ELSE CASE seed % 12
         WHEN 0 THEN concat('“', cls, '” it’s $x’_', CAST(seed AS STRING), '$ ‘q’ $$y“$$ ’ $open ’')
         WHEN 1 THEN concat('```', chr(10), 'кoд ', CAST(seed AS STRING), chr(10), '```', chr(10), 'Бу сeр ', CAST(seed AS STRING))
         WHEN 2 THEN concat('| a | b |', chr(10), '| --- | :-: |', chr(10), '| 1 | ', CAST(seed AS STRING), ' |')
         WHEN 3 THEN concat(' $$ x_', CAST(seed AS STRING), ' $$')
         WHEN 4 THEN concat('  # **Part ', CAST(seed AS STRING), '**.', chr(10), 'body ')
         WHEN 5 THEN concat('<p>x<TABLE a="1"><tr><td colspan="', CAST(seed AS STRING), '" style="y"><i>a &amp; b</i></Table><table></table>')
         WHEN 6 THEN concat('<th scope=" ROW ">a<SUP />', CAST(seed AS STRING), ' b<sub/> `code сe` бу a')
         WHEN 7 THEN concat(chr(92), 'frac{{a}}{{', CAST(seed AS STRING), chr(92), '}} ', chr(92), '$5 ’ $z$ ’')
         WHEN 8 THEN concat('text', chr(10), '~~~', chr(10), 'кoд ’', CAST(seed AS STRING))
         WHEN 9 THEN concat(chr(92), '[ x', chr(10), CAST(seed AS STRING), ' ', chr(92), ']')
         WHEN 10 THEN concat('```latex', chr(10), '$y', chr(10), CAST(seed AS STRING), '$', chr(10), '```')
         ELSE concat(' ', CAST(seed % 90 AS STRING), ') word ', CAST(seed AS STRING), ' ') END END AS content,
       CASE seed % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'manual' WHEN 2 THEN ' OK ' WHEN 3 THEN 'odd' ELSE 'ok' END AS extraction_status,
       CASE WHEN seed % 8 = 0 THEN 'timeout' ELSE NULL END AS error_message,
       concat('2024-01-', lpad(CAST(1 + (seed * 3) % 28 AS STRING), 2, '0'), 'T00:00:00+00:00') AS updated_at
FROM (SELECT l.*, d.text AS body FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY deal ORDER BY layout_id) = 1 THEN deal END AS k FROM (SELECT *, page_id % (SELECT count(*) FROM {documents}) AS deal FROM {d_layouts_n} WHERE seed % 7 <> 0) n) l
      LEFT JOIN {documents} d ON d.doc_id = l.k) t"""

VIEWS["d_bindings"] = """
SELECT layout_id AS caption_layout_id, target AS target_layout_id FROM (
  SELECT layout_id, cls, seed, min(CASE WHEN cls IN ('table', 'picture', 'formula') THEN layout_id END) OVER (PARTITION BY page_id ORDER BY reading_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target
  FROM {d_layouts_n}) t WHERE cls = 'caption' AND target IS NOT NULL AND seed % 5 <> 0"""

VIEWS["d_configs"] = """
SELECT 0 AS cfg, 'model-a' AS model, 512 AS image_size, CAST(2 AS DOUBLE)/10 AS conf, CAST(45 AS DOUBLE)/100 AS iou UNION ALL
SELECT 1, 'model-a', 1024, CAST(2 AS DOUBLE)/10, CAST(45 AS DOUBLE)/100 UNION ALL
SELECT 2, 'model-b', 512, CAST(2 AS DOUBLE)/10, CAST(45 AS DOUBLE)/100 UNION ALL
SELECT 3, 'model-b', 1024, CAST(2 AS DOUBLE)/10, CAST(45 AS DOUBLE)/100"""

VIEWS["d_results"] = """
SELECT page_id * 100 + cfg * 10 + v AS result_id, page_id, concat('fp-', CAST(v AS STRING)) AS page_fingerprint, model, image_size, conf, iou, cfg,
       CAST((page_id * 37 + cfg * 101 + v * 13) % 1000 AS DOUBLE) / 1000 AS score,
       concat('2024-02-', lpad(CAST(1 + (page_id * 5 + cfg * 3 + v * 11) % 28 AS STRING), 2, '0')) AS updated_at
FROM {d_pages} CROSS JOIN {d_configs} CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1) f WHERE (page_id + cfg) % 6 <> 0"""

VIEWS["d_jobs"] = """
SELECT event_id AS job_id, CASE event_id % 5 WHEN 0 THEN 'layout_detect' WHEN 1 THEN 'layout_benchmark' WHEN 2 THEN 'discovery' ELSE 'ocr_extract' END AS stage, user_id AS page_id,
       CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'not json'
            ELSE concat('{{"trigger":"', CASE WHEN event_id % 5 > 2 THEN ' Batch_OCR ' ELSE 'manual' END, '","batch_run_id":', CASE WHEN event_id % 3 = 0 THEN '""' ELSE concat('"run-', CAST(CAST(floor(event_id / 50) AS BIGINT) AS STRING), '"') END,
                        ',"batch_total_layouts":', CAST(40 + event_id % 30 AS STRING), ',"layout_ids":[', CAST(event_id AS STRING), ',', CAST(event_id + 1 AS STRING), ',', CAST(event_id AS STRING), ',0]}}') END AS payload_json,
       CASE WHEN event_id % 7 > 2 THEN concat('{{"extracted_count":', CAST(event_id % 4 AS STRING), ',"skipped_count":', CAST(event_id % 2 AS STRING), ',"skipped":', CASE WHEN event_id % 9 = 0 THEN 'true' ELSE 'false' END, '}}')
            WHEN event_id % 7 = 1 THEN concat('{{"progress":{{"processed_layouts":', CAST(event_id % 5 AS STRING), ',"total_layouts":3}}}}') END AS result_json,
       event_id % 3 AS attempts, concat(substr(CAST(ts AS STRING), 1, 10), 'T00:00:00+00:00') AS created_at
FROM {events}"""

VIEWS["d_events"] = """
SELECT event_id AS id, ts, user_id AS page_id,
       CASE event_id % 6 WHEN 0 THEN 'layout_detect' WHEN 1 THEN 'ocr_extract' WHEN 2 THEN 'layout_review' WHEN 3 THEN 'ocr_review' WHEN 4 THEN 'layout_benchmark' ELSE 'discovery' END AS stage,
       CASE event_id % 8 WHEN 0 THEN 'job_started' WHEN 1 THEN 'job_completed' WHEN 2 THEN 'job_failed' WHEN 3 THEN 'manual_review_completed' WHEN 4 THEN 'job_queued'
            WHEN 5 THEN 'job_progress' WHEN 6 THEN 'job_completed' ELSE 'scan_finished' END AS event_type,
       event_id % 5 = 0 AS skipped, concat('message ', CAST(event_id AS STRING)) AS message
FROM {events}"""

# every document is a file; names do not depend on contents
VIEWS["d_scan"] = """
SELECT concat('box', CAST(doc_id % 10 AS STRING), '/', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.tiff' ELSE '.txt' END) AS rel_path, {sha256}(text) AS file_hash
FROM (SELECT doc_id, coalesce(text, '') AS text FROM {documents}) t"""

# pages of an earlier scan: some under other names, some under the name that is another file's now, some with other contents
VIEWS["d_known"] = """
SELECT doc_id AS page_id, concat(CASE WHEN doc_id % 5 = 0 OR doc_id % 8 = 5 THEN 'old/' ELSE '' END, 'box', CAST(place % 10 AS STRING), '/', CAST(place AS STRING), CASE place % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.tiff' ELSE '.txt' END) AS rel_path,
       CASE WHEN doc_id % 7 = 0 THEN concat('stale-', CAST(doc_id AS STRING)) ELSE {sha256}(text) END AS file_hash, doc_id % 9 = 0 AS is_missing
FROM (SELECT *, CASE WHEN doc_id % 8 = 4 THEN doc_id + 1 ELSE doc_id END AS place FROM (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS copy FROM {documents}) d) t WHERE copy = 1"""

VIEWS["d_duplicates"] = """
SELECT concat(CASE WHEN doc_id % 3 = 0 THEN 'gone/' ELSE '' END, 'box', CAST(doc_id % 10 AS STRING), '/', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.tiff' ELSE '.txt' END) AS rel_path, 'before' AS file_hash, doc_id AS canonical_page_id
FROM {documents} WHERE doc_id % 4 <> 3"""

#: Spark's own form of views. The order of d_layouts ends with the last column that a row of it is made of: lines that agree up to there give
#: equal rows in either order, so the others need not be sorted and shuffled. The join of d_outputs is by the deal, by which the rows lie together already, and the first row alone takes
#: the text: by k, which is null for all rows but one of a deal, these would meet in one task.
IN_SPARK = {
    "d_layouts": VIEWS["d_layouts"].replace(",l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate", ""),
    "d_outputs": VIEWS["d_outputs"]
    .replace("CASE WHEN row_number() OVER (PARTITION BY deal ORDER BY layout_id) = 1 THEN deal END AS k", "row_number() OVER (PARTITION BY deal ORDER BY layout_id) AS nth")
    .replace("d.doc_id = l.k", "d.doc_id = l.deal AND l.nth = 1")
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def needs(sql: str) -> list[str]:
    """Views that a query names, in an order in which each comes after what it needs."""
    out: list[str] = []
    for name in _NAME.findall(sql):
        if name in VIEWS and name not in out:
            out += [x for x in [*needs(VIEWS[name]), name] if x not in out]
    return out


def with_views(sql: str) -> str:
    """DuckDB SQL: {name} of a view or table becomes its name, views become common table expressions."""
    plain = lambda s: _NAME.sub(lambda m: "sha256" if m[1] == "sha256" else m[1], s).replace("{{", "{").replace("}}", "}")
    used = needs(sql)
    head = ", ".join(f"{v} AS ({plain(VIEWS[v])})" for v in used)
    body = plain(sql)
    if not used:
        return body
    return re.sub(r"^\s*WITH ", f"WITH {head}, ", body) if re.match(r"\s*WITH (?!RECURSIVE)", body) else re.sub(r"^\s*WITH RECURSIVE ", f"WITH RECURSIVE {head}, ", body) if re.match(r"\s*WITH RECURSIVE", body) else f"WITH {head} {body}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir or a view over its tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return select(spark, sf_dir, IN_SPARK.get(name, VIEWS[name]))


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over tables and views named in braces."""
    names = dict.fromkeys(x for x in _NAME.findall(sql) if x != "sha256")
    frames = {n: frame(spark, sf_dir, n) for n in names}
    return spark.sql(sql.replace("{sha256}", "spark_sha256").replace("spark_sha256(text)", "sha2(text, 256)"), **frames)
