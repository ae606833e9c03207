"""Settings, quotas, histories and keys on cases worked out by hand."""

import json

from pagewright.operators import extraction, orders, quotas
from pagewright.sources import settings


def test_settings_from_file_and_environment(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"root": "in", "keys": {"a": "k1, k2", "b": ["k2", "k3"]}, "suffixes": ["PNG", ".gif"], "discover_at_start": "yes"}))
    s = settings.load(str(tmp_path / "s.json"), {"PAGEWRIGHT_ROOT": "elsewhere"})
    assert (s.root, s.keys, s.suffixes, s.discover_at_start, s.models) == ("elsewhere", ("k1", "k2", "k3"), (".png", ".gif"), True, ("default",))
    assert settings.load(None, {}) == settings.Settings()
    assert settings.check_detection(0.5, 1.5, 16) == ["iou", "image_size"] and not settings.check_detection(0, 1, 32)
    assert settings.truth("maybe", True) and not settings.truth("OFF", True)


def test_quotas(spark):
    rows = spark.createDataFrame([("book", True)] * 50 + [("legal", True)] * 3 + [("book", False), ("other", True)], "kind string, kept boolean")
    assert {r.kind: (r.n, r.met) for r in quotas.coverage(rows, "kind", "kept", quotas.TYPES).collect()} == {"book": (50, True), "legal": (3, False), "periodical": (0, False), "misc": (0, False)}


def test_history_drops_repeats_and_keeps_the_last(spark):
    rows = spark.createDataFrame([(1, t, p) for t, p in enumerate([5, 5, 6, 5, 7])], "u int, at int, page int")
    assert orders.visit_history(rows, "u", "page", "at").first().history == [5, 6, 5, 7]
    assert orders.visit_history(rows, "u", "page", "at", most=2).first().history == [5, 7]


def test_natural_order(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a10",), ("A2",), ("a02b",), ("b1",)], "c string")
    assert [r.c for r in rows.orderBy(orders.natural_key(F.col("c"))).collect()] == ["A2", "a02b", "a10", "b1"]


def test_post_processing(spark):
    layouts = spark.createDataFrame(
        [(1, 10, "section_header", 0.1, 0.0, 0.9, 0.1), (1, 11, "text", 0.1, 0.2, 0.9, 0.24), (1, 12, "list_item", 0.17, 0.3, 0.9, 0.33), (1, 13, "list_item", 0.1, 0.4, 0.9, 0.43), (1, 14, "formula", 0.1, 0.5, 0.9, 0.6), (1, 15, "picture", 0.1, 0.7, 0.9, 0.9)],
        "page_id long, layout_id long, cls string, x1 double, y1 double, x2 double, y2 double",
    )
    texts = spark.createDataFrame([(10, "# **One**"), (11, "it’s $a’$"), (12, "* x"), (13, "1) y"), (14, "$$ z’ $$"), (15, "no")], "layout_id long, content string")
    got = {r.layout_id: r.content for r in extraction.post_processed(layouts, texts).collect()}
    assert got == {10: "## One", 11: "it's $a’$", 12: "    - x", 13: "1) y", 14: "z’"}
