"""Physical plans of the training-data operators."""

import re

import pytest

from pagewright.llm import op1_license_scan, op2_suffix_array, op3_quality_rules, op5_suffix_trees, op9_decontamination

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("module", [op1_license_scan, op3_quality_rules, op9_decontamination])
def test_native_operators_run_no_python(spark, module):
    text = plan(module.query(spark, SF))
    assert not re.search("Python|Pandas|Arrow", text) and "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("module", [op2_suffix_array, op5_suffix_trees])
def test_texts_are_not_sorted(spark, module):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(module.query(spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
    assert ("ReusedExchange" in text) == (module is op2_suffix_array)  # op5 reads texts for what it compares in a job of its own


def test_quality_measures_split_each_text_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(op3_quality_rules.measures(docs).where("n_repeat_words >= 0").select("doc_id"))
    assert text.count("split(") >= 1
    assert "split(" not in plan(op3_quality_rules.passing(docs))  # the measures are written once, with the rows that pass
