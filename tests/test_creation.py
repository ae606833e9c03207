"""Boxes that are asked for and boxes that are detected, on pages worked out by hand."""

from pagewright.operators import creation

BOX = "x1 double, y1 double, x2 double, y2 double"
LAYOUTS = f"layout_id long, page_id long, reading_order int, class_name string, orientation string, {BOX}"
REQUESTS = f"request_id long, page_id long, class_name string, orientation string, reading_order int, {BOX}"


def rows_of(df):
    return {(r.page_id, r.layout_id or -r.request_id): (r.reading_order, r.class_name, r.orientation) for r in df.collect()}


def test_boxes_are_created_in_their_places(spark):
    layouts = spark.createDataFrame([(1, 1, 1, "text", "horizontal", 0.1, 0.1, 0.9, 0.2), (2, 1, 5, "text", "horizontal", 0.1, 0.5, 0.9, 0.6), (9, 4, 3, "text", "horizontal", 0.1, 0.1, 0.9, 0.2)], LAYOUTS)
    pages = spark.createDataFrame([(1, "single", False), (2, "auto", None), (3, "single", True), (4, "single", False)], "page_id long, order_mode string, is_missing boolean")
    requests = [
        (10, 1, "Title", None, None, 0.1, 0.3, 0.9, 0.4), (11, 1, "Text", " V ", 1, 0.1, 0.7, 0.2, 0.9), (12, 1, "Table", None, 99, 0.1, 0.0, 0.15, 0.9), (20, 2, "Picture", None, None, 0.2, 0.2, 0.4, 0.4),
        (30, 3, "Text", None, None, 0.1, 0.1, 0.2, 0.2), (40, 9, "Text", None, None, 0.1, 0.1, 0.2, 0.2), (50, 1, "Text", None, None, 0.5, 0.1, 0.5, 0.2), (51, 1, "Text", None, 0, 0.5, 0.1, 0.6, 0.2), (52, 1, " ", None, None, 0.5, 0.1, 0.6, 0.2),
    ]
    asked = spark.createDataFrame(requests, REQUESTS)
    out, status = creation.created(layouts, pages, asked)
    got = rows_of(out)
    # page 1: 1 and 2 closed up; 10 between them by height, 11 first, 12 last
    assert {k[1]: v[0] for k, v in got.items() if k[0] == 1} == {-11: 1, 1: 2, -10: 3, 2: 4, -12: 5}
    assert got[1, -10][1:] == ("section_header", "horizontal") and got[1, -11][2] == "vertical" and got[1, -12][2] == "vertical"
    assert got[2, -20][0] == 1 and got[4, 9][0] == 3 and {k[0] for k in got} == {1, 2, 4}
    assert {(r.page_id, r.status) for r in status.collect()} == {(1, "layout_detected"), (2, "layout_detected")}
    why = {r.request_id: r.error for r in creation.refused(pages, asked).collect()}
    assert {k: v for k, v in why.items() if v} == {30: "page is missing", 40: "page not found", 50: "empty box", 51: "order below one", 52: "no class"}
    same, none = creation.created(layouts, pages, asked.limit(0))
    assert same.count() == 3 and none.count() == 0


def test_detector_rows_are_cleaned(spark):
    found = spark.createDataFrame(
        [(1, 1, "Title", 0.9, -0.2, 0.5, 0.4, 0.6), (1, 2, "Text", 0.8, 0.0, 0.5, 0.4, 0.61), (1, 3, "List-item", 0.5, 0.5, 0.1, 1.7, 0.2), (1, 4, "Text", 0.7, 1.1, 0.1, 1.3, 0.2), (1, 5, " ", 0.7, 0.1, 0.1, 0.3, 0.2), (1, 6, "Text", None, 0.1, 0.1, 0.3, 0.2), (2, 7, "Text", 0.1, 0.1, 0.9, 0.3, 0.8)],
        f"page_id long, pred_id long, class_name string, confidence double, {BOX}",
    )
    out = creation.cleaned(found, ["page_id"])
    got = sorted((r.place, r.pred_id, r.class_name, r.x1, r.x2) for r in out.collect())
    assert got == [(1, 6, "text", 0.1, 0.3), (2, 3, "text", 0.5, 1.0), (3, 1, "section_header", 0.0, 0.4)]
    layouts = spark.createDataFrame([(1, 1, 4, "text", "h", 0.0, 0.0, 0.1, 0.1), (2, 2, 1, "text", "h", 0.0, 0.0, 0.1, 0.1), (3, 3, 1, "text", "h", 0.0, 0.0, 0.1, 0.1)], LAYOUTS)
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    new = creation.with_detections(layouts, out, pages, True)
    assert sorted((r.page_id, r.layout_id or 0, r.reading_order) for r in new.collect()) == [(1, 0, 1), (1, 0, 2), (1, 0, 3), (3, 3, 1)]
    more = creation.with_detections(layouts, out, pages, False)
    assert sorted((r.page_id, r.layout_id or 0, r.reading_order) for r in more.collect()) == [(1, 0, 5), (1, 0, 6), (1, 0, 7), (1, 1, 4), (2, 2, 1), (3, 3, 1)]


def test_settings_that_are_offered(spark):
    from pagewright.operators import bindings

    rows = [(1, "a", "512", 0.5), (2, " a ", "512.0", 0.9), (3, "b", "512", None), (4, "c", "31", 0.9), (5, "", "512", 0.9), (6, "d", "512.5", 0.9), (7, "e", "big", 0.9), (8, "f", "64", 0.5), (9, "g", "64", float("nan")), (10, None, "64", 1.0)]
    df = spark.createDataFrame(rows, "n int, model string, image_size string, mean double")
    assert [tuple(r) for r in bindings.offered(df, "n").collect()] == [("a", 512, 0.5), ("f", 64, 0.5), ("b", 512, 0.0)]
