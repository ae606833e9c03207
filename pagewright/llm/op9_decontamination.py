"""Benchmark decontamination: which documents hold which test items.

Method, null and short texts: see containment.contained. Defined results: a
document matches an item when it holds, wherever they stand, at least 80 of 100
of the item's distinct five-word shingles, or, if the item has fewer than five
words, all of them in a row; empty tables give an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .containment import contained

NAME = "op9_benchmark_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


QUERIES = {NAME: query}


def oracle(docs: str, items: str) -> str:
    """DuckDB SQL of the matches, by containment in whole texts; docs and items: subqueries with (id, text)."""
    words = r"""SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {}"""
    return f"""
WITH iw AS (SELECT id, w, least(5, len(w)) AS k FROM ({words.format(items)}) WHERE len(w) > 0),
q AS (SELECT id, k, w[i+1:i+k] AS h, len(w) - k + 1 AS n FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS i FROM iw)),
q1 AS (SELECT id AS item_id, h, 2 ** (floor(log2(any_value(n))) + 1) AS size FROM q GROUP BY 1, 2),
qn AS (SELECT item_id, count(*) AS n_shingles FROM q1 GROUP BY 1),
d AS (SELECT id, i, w[i+1:i+k] AS h FROM (SELECT id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM ({words.format(docs)}), (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
v AS (SELECT d.id AS doc_id, d.i, d.h, q1.item_id, q1.size FROM d JOIN q1 ON d.h = q1.h),
n AS (SELECT doc_id, item_id, count(DISTINCT h) AS n_found FROM v GROUP BY 1, 2),
w AS (SELECT doc_id, item_id, h, i, unnest([floor(i / size), floor(i / size) - 1]) AS win FROM v),
c AS (SELECT doc_id, item_id, win, count(DISTINCT h) AS n, min(i) AS first FROM w GROUP BY 1, 2, 3),
f AS (SELECT doc_id, item_id, arg_min(first, first - n * 1000000000) AS first_word FROM c GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, first_word FROM n JOIN qn USING (item_id) JOIN f USING (doc_id, item_id) WHERE 100 * n_found >= 80 * n_shingles"""


ORACLES = {NAME: oracle("(SELECT doc_id AS id, text FROM documents)", "(SELECT item_id AS id, text FROM benchmark)")}
