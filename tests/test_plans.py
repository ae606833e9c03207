"""Physical plans: what reaches the scans, and what must not appear."""

import re

import pytest

from pagewright.catalog import QUERIES
from pagewright.plans.views import frame

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product_and_no_python_row_by_row(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_scans_read_the_columns_that_are_needed(spark):
    text = plan(QUERIES["canonical_files"](spark, SF))
    assert all("embedding" not in s and "lang" not in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text))
    text = plan(frame(spark, SF, "orders").where("o_orderkey = 7").select("o_orderkey"))
    assert "EqualTo(o_orderkey,7)" in text and "ReadSchema: struct<o_orderkey:bigint>" in text


def test_anti_joins_are_anti_joins(spark):
    for name in ("pending_layouts", "stale_pages", "missing_outputs", "benchmark_tasks"):
        assert "LeftAnti" in plan(QUERIES[name](spark, SF))


def test_aggregates_are_partial_first(spark):
    assert "partial_count" in plan(QUERIES["class_counts"](spark, SF)) and "partial_max_by" in plan(QUERIES["latest_states"](spark, SF))
