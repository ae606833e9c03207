"""Rules that SQL does not cover, on cases worked out by hand."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import normalise as N
from pagewright.functions import text as T
from pagewright.operators import matching, paging, reading_order
from pagewright.sources import inventory, providers

Item = reading_order.Item


def page(*boxes):
    return [Item(i, *b) for i, b in enumerate(boxes, 1)]


def test_single_column_goes_down():
    items = page((0.1, 0.6, 0.9, 0.7), (0.1, 0.1, 0.9, 0.2), (0.1, 0.3, 0.9, 0.5))
    assert reading_order.ordered(items, "single") == [2, 3, 1]
    assert reading_order.inferred_mode(items) == "single"


TWO_COLUMNS = page((0.1, 0.30, 0.3, 0.45), (0.38, 0.30, 0.58, 0.45), (0.1, 0.5, 0.3, 0.7), (0.38, 0.5, 0.58, 0.7), (0.05, 0.02, 0.95, 0.1), (0.05, 0.9, 0.95, 0.97))


def test_columns_with_spanning_boxes():
    got = reading_order.ordered(TWO_COLUMNS, "multi-column")
    assert got.index(1) < got.index(3) < got.index(2) < got.index(4)
    assert got[-1] == 6


def test_adaptive_order_reads_heading_columns_footer():
    assert reading_order.ordered(TWO_COLUMNS, "auto") == [5, 1, 3, 2, 4, 6]


def test_two_pages_left_first():
    items = page((0.55, 0.1, 0.9, 0.2), (0.05, 0.1, 0.4, 0.2), (0.55, 0.3, 0.9, 0.4), (0.05, 0.3, 0.4, 0.4))
    assert reading_order.inferred_mode(items) == "two-page"
    assert reading_order.ordered(items, "auto") == [2, 4, 1, 3]


def test_insertion_follows_the_box_above():
    items = [Item(1, 0.1, 0.1, 0.9, 0.2, 1), Item(2, 0.1, 0.3, 0.9, 0.4, 2)]
    assert reading_order.insertion_place(items, Item(-1, 0.1, 0.22, 0.9, 0.28), "single") == 2
    assert reading_order.insertion_place([], Item(-1, 0.1, 0.2, 0.9, 0.3), "auto") == 1


def test_average_precision_of_a_shifted_box(spark):
    truth = spark.createDataFrame([(1, 1, "text", 0.1, 0.1, 0.6, 0.6)], "page_id long, layout_id long, cls string, x1 double, y1 double, x2 double, y2 double")
    found = spark.createDataFrame([(0, 1, 1, "text", 0.9, 0.15, 0.15, 0.65, 0.65)], "cfg int, page_id long, pred_id long, cls string, confidence double, x1 double, y1 double, x2 double, y2 double")
    row = matching.class_scores(truth, found, ["cfg"]).first()
    assert row.ap50 == 1.0 and row.ap == pytest.approx(0.4)  # overlap .681: four of ten thresholds


def test_class_without_truth_scores_zero_and_empty_page_one(spark):
    truth = spark.createDataFrame([(1, 1, "text", 0.1, 0.1, 0.6, 0.6)], "page_id long, layout_id long, cls string, x1 double, y1 double, x2 double, y2 double")
    found = spark.createDataFrame([(0, 1, 1, "table", 0.9, 0.1, 0.1, 0.6, 0.6)], "cfg int, page_id long, pred_id long, cls string, confidence double, x1 double, y1 double, x2 double, y2 double")
    classes = matching.class_scores(truth, found, ["cfg"])
    assert {(r.cls, r.ap) for r in classes.collect()} == {("text", 0.0), ("table", 0.0)}
    pages = spark.createDataFrame([(0, 1), (0, 2)], "cfg int, page_id long")
    assert {r.page_id: r.map50_95 for r in matching.page_scores(classes, pages, ["cfg"]).collect()} == {1: 0.0, 2: 1.0}


def test_emphasis_and_headings():
    assert T._without_emphasis("**Title**.") == "Title."
    assert T._without_emphasis("***a***") == "a"
    assert T._without_emphasis("****") == "**"
    assert T._without_emphasis("**") == "**"
    assert T._headed("\n  ### __One__\ntwo", 9) == "###### One\ntwo"
    assert T._headed("  ", 2) == ""


def test_quotes_outside_math():
    assert T._fold_outside_math("‘a’ $b’$ ’") == "'a' $b’$ '"
    assert T._fold_outside_math(r"\$ ’ $$x’ $ y’$$ ’") == r"\$ ' $$x’ $ y’$$ '"
    assert T._fold_outside_math("’ $open’") == "' $open’"


LOOKALIKE_TEXTS = (
    ("Бу сeр", [(0, "сeр", "сер", 3)]),
    ("hello", []),
    ("бу a китап", [(0, "a", "а", 3)]),
    ("```\nБу сeр\n```\n`сeр`", []),
    ("``` \nсeр\n~~~\n```\nсeр", [(4, "сeр", "сер", 0)]),
    ("````\nсeр\n```\nсeр\n````\n\nсeр\n", [(6, "сeр", "сер", 0)]),
    ("~~~ open\nсeр", []),
    ("сeр ` сeр ``сeр` сeр`` б", [(0, "сeр", "сер", 0), (0, "сeр", "сер", 17)]),
    ("``` бу a", []),
    ("a ``` сeр", [(0, "сeр", "сер", 6)]),
    ("`x` a\r\nбу a_1 o2\x0bo бу", [(1, "a_1", "а_1", 3), (1, "o2", "о2", 7), (2, "o", "о", 0)]),
    ("сe\u0301р", [(0, "сéр", "сер", 0)]),
    (None, []),
    ("", []),
)


def test_lookalikes_skip_code_and_need_company(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LOOKALIKE_TEXTS)], "i int, t string")
    got = {r.i: [(w.line_index, w.token, w.normalized_token, w.token_start) for w in r.w] for r in T.lookalikes(df, "t", "w").collect()}
    for i, (text, want) in enumerate(LOOKALIKE_TEXTS):
        assert got[i] == want, text
    one = T.lookalikes(spark.createDataFrame([("x сeo",)], "t string"), "t").first().warnings
    assert [(w.token_start, w.token_end, [tuple(x) for x in w.replacements]) for w in one] == [(0, 1, [("x", "х")]), (2, 5, [("e", "е"), ("o", "о")])]
    many = len(T.lookalikes(spark.createDataFrame([("сe " * 300,)], "t string"), "t").first().warnings)
    assert many == 200
    assert T.without_spans("a `b` ``c` d`` e ```f").replace("\0", "_") == "a ___ ________ e ___f"


def test_html_text(spark):
    rows = [
        ("<p>a &eacute;&#233;&amp;lt;</p>< BR / >b\u00a0 c<td>d</td>\n\n  e", " HTML ", "a éé&lt;\n\nb\u00a0 c d\n\ne"),
        ("<b>x</b> &amp;", "markdown", "<b>x</b> &amp;"),
        (None, "html", ""),
        ("y" * 5000, "html", "y" * 4000),
    ]
    got = spark.createDataFrame(rows, "c string, f string, want string").select("want", T.html_text(F.col("c"), F.col("f")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_tables_are_cleaned():
    assert T.clean_table("no") is None
    assert T.clean_table('<table><tr><td colspan="900" x="1">a & b<script>') is None
    assert T.clean_table('x<table a=1><tr><th rowspan=2 colspan = "0">A<br/>B<td onclick="x>y">q</tr></tr></table></table>') == '<table><tr><th rowspan="2" colspan="1">A<br>B<td>q</td></th></tr></table>'
    assert T.clean_table("<table><table><TABLE><td>a < b <!-- no --><b>c</b></table>") == "<table><table><table><td>a &lt; b c</td></table></table></table>"
    assert T.clean_table('<table></br></td><td rowspan="3x" data-colspan="4">1</td></table>') == "<table><td>1</td></table>"
    assert T.clean_table('<TABLE><tr><td colspan="900">a &amp; b</table>') == '<table><tr><td colspan="200">a &amp; b</td></tr></table>'


def test_cursor_round_trip_and_rejection(spark):
    df = spark.createDataFrame([("a\"é", 7)], "v string, i long").select(paging.cursor("rel_path", "asc", F.col("v"), F.col("i")).alias("c"))
    raw = df.first().c
    assert json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4))) == {"s": "rel_path", "d": "asc", "v": 'a"é', "i": 7}
    assert df.select(paging.decoded(F.col("c"), "rel_path", "desc").alias("x")).first().x is None
    assert spark.range(1).select(paging.decoded(F.lit("!!!"), "rel_path", "asc").alias("x")).first().x is None


def test_pages_equal_the_whole(spark):
    df = spark.range(45).select(F.col("id"), (F.col("id") % 4).alias("k"))
    assert [r.id for r in paging.all_pages(df, "k", "id", 7)] == [r.id for r in df.orderBy("k", "id").collect()]


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.PNG").write_bytes(b"a")
    (tmp_path / "a.png").write_bytes(b"a")
    (tmp_path / ".png").write_bytes(b"a")
    (tmp_path / "n.txt").write_bytes(b"a")
    rows = inventory.canonical(inventory.scan(spark, str(tmp_path))).orderBy("rel_path").collect()
    assert [(r.rel_path, r.canonical) for r in rows] == [("a.png", True), ("b/x.PNG", False)]
    assert inventory.parse_suffixes(" PNG, .jpg,,png ") == (".png", ".jpg") and inventory.parse_suffixes("") == inventory.SUFFIXES


def test_providers(spark):
    pages = spark.createDataFrame([(1, "a.png"), (2, "b.png")], "page_id long, rel_path string")
    found = providers.detected(pages, lambda: lambda path, p: [{"class_name": "text", "confidence": p["c"], "x1": 0.1, "y1": 0.1, "x2": 0.1 if path == "b.png" else 0.5, "y2": 0.5}], {"c": 0.5})
    assert [r.page_id for r in found.collect()] == [1]

    def make():
        left = {"k1": 1, "k2": 0}  # calls before a key is over its quota

        def call(key, prompt):
            if prompt == "bad":
                raise RuntimeError("503")
            if key in left and left[key] == 0:
                raise RuntimeError("429: quota per day" if key == "k2" else "rate limit")
            left[key] = left.get(key, 9) - 1
            return prompt.upper()

        return call

    crops = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "more")], "layout_id long, prompt string").coalesce(1)
    got = {r.layout_id: (r.raw, r.error, r.calls) for r in providers.transcribed(crops, make, ("k1", "k2")).collect()}
    assert got == {1: ("OK", None, 1), 2: (None, "503", 2), 3: (None, "rate limit", got[3][2])}
    got = {r.layout_id: (r.raw, r.used_key) for r in providers.transcribed(crops.where("layout_id <> 2"), make, ("k1", "k2", "k3"), exhausted=("k3",)).collect()}
    assert got == {1: ("OK", "k1"), 3: ("MORE", "k3")}  # the pool is tried again once all others are out
    assert providers.transcribed(crops.where("layout_id = 1"), make, ()).first().error == "no usable key"
    assert providers.exhausted_keys('["k1", " k2 ", "", "k1", 7]') == ["k1", "k2", "7"]
    assert [providers.exhausted_keys(x) for x in ("", "k1\nk2", '{"a": 1}', '"k1"')] == [[]] * 4
    with pytest.raises(ValueError, match="placeholders"):
        providers.rendered_prompt("{what}", F.lit(""), F.lit(""), F.lit(""))


def test_null_and_odd_names(spark):
    df = spark.createDataFrame([(None,), (" A - b/c ",)], "c string").select(N.class_core(F.col("c")).alias("core"), N.class_loose(F.col("c")).alias("loose"), N.order_mode(F.col("c")).alias("mode"))
    assert [tuple(r) for r in df.collect()] == [("", "", "auto"), ("a___b_c", "a_b_c", "auto")]
    with pytest.raises(Exception, match="unknown phase"):
        df.select(N.qa_phase(F.col("core"))).collect()


def test_streams(spark, tmp_path):
    from pagewright.streaming import activity

    rows = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", 5, "layout_detect", "job_started", False, "a"), (2, "2024-01-01 00:10:00", 5, "layout_detect", "job_completed", False, "b"), (3, "2024-01-01 01:10:00", 6, "ocr_extract", "job_completed", True, "c")],
        "id long, ts string, page_id long, stage string, event_type string, skipped boolean, message string",
    ).withColumn("ts", F.to_timestamp("ts"))
    for i in (1, 2, 3):
        rows.where(f"id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    events = activity.event_stream(spark, str(tmp_path / "events"))
    q = activity.to_table(activity.states(events), "page_states", str(tmp_path / "c1"), mode="complete")
    q.awaitTermination(60)
    assert [(r.page_id, r.status, r.id) for r in spark.table("page_states").collect()] == [(5, "layout_detected", 2)]
    q = activity.to_table(activity.activity(events), "activity", str(tmp_path / "c2"), mode="complete")
    q.awaitTermination(60)
    assert spark.table("activity").agg(F.sum("n")).first()[0] == 3
    q = activity.upsert_batches(activity.states(events), str(tmp_path / "t"), "page_id", str(tmp_path / "c3"))
    q.awaitTermination(60)
    last = max((tmp_path / "t").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert [(r.page_id, r.status) for r in spark.read.parquet(str(last)).collect()] == [(5, "layout_detected")]


def test_dataset_lines(spark, tmp_path):
    from pagewright.plans.views import frame
    from pagewright.sources import dataset

    sf = "/root/testdata/sf0.001"
    pages = dataset.nested_pages(*[frame(spark, sf, t) for t in ("d_pages", "d_layouts_n", "d_outputs", "d_bindings")]).limit(3)
    dataset.write_dataset(pages, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 3 and all([i["order"] for i in p["items"]] == sorted(i["order"] for i in p["items"]) for p in lines)


def test_discovery_takes_files_one_after_the_other(spark):
    """Renames free a path for new files only if they come first in the order of hashes."""
    known = spark.createDataFrame([(1, "a.png", "X", False), (2, "b.png", "M", True), (3, "c.png", "Q", False)], "page_id long, rel_path string, file_hash string, is_missing boolean")

    def actions(*files):
        found = spark.createDataFrame(files, "rel_path string, file_hash string")
        return {(r.page_id, r.rel_path, r.action) for r in inventory.reconcile(found, known).collect()}

    late = actions(("b2.png", "X"), ("a.png", "Y"))
    assert late == {(1, "b2.png", "renamed"), (None, "a.png", "inserted"), (3, "c.png", "missing")}
    early = actions(("b2.png", "X"), ("a.png", "A"))
    assert early == {(1, "a.png", "rehashed"), (None, "b2.png", "inserted"), (3, "c.png", "missing")}
    # A takes page 1; X is without a page and takes page 2 at b.png only if M's file, which is page 2's own, comes later; M < X, so page 2 has gone to z.png
    assert actions(("a.png", "A"), ("b.png", "X"), ("z.png", "M"), ("c.png", "Q")) == {(1, "a.png", "rehashed"), (None, "b.png", "inserted"), (2, "z.png", "renamed"), (3, "c.png", "unchanged")}
    assert actions(("b.png", "M")) == {(2, "b.png", "revived"), (1, "a.png", "missing"), (3, "c.png", "missing")}


def test_discovery_equals_taking_files_in_turn(spark):
    import random

    r = random.Random(5)
    for _ in range(6):
        n = 12
        hashes, paths = [f"h{i:02d}" for i in range(n)], [f"p{i:02d}" for i in range(n)]
        known = [(i, p, h, r.random() < 0.3) for i, (p, h) in enumerate(zip(r.sample(paths, 8), r.sample(hashes, 8)), 1)]
        files = list(zip(r.sample(paths, 9), r.sample(hashes, 9)))
        pages = {i: [p, h] for i, p, h, _ in known}
        by_hash, by_path = {h: i for i, _, h, _ in known}, {p: i for i, p, _, _ in known}
        want = set()
        for path, h in sorted(files, key=lambda f: f[1]):
            if h in by_hash:
                i = by_hash[h]
                if pages[i][0] != path:
                    by_path.pop(pages[i][0], None)
                pages[i][0] = path
                by_path[path] = i
            elif path in by_path:
                i = by_path[path]
                by_hash.pop(pages[i][1], None)
                pages[i][1] = h
                by_hash[h] = i
            else:
                i = None
            want.add((i, path, h))
        seen = {i for i, _, _ in want}
        want |= {(i, p, h) for i, p, h, gone in known if i not in seen and not gone}
        got = inventory.reconcile(spark.createDataFrame(files, "rel_path string, file_hash string"), spark.createDataFrame(known, "page_id long, rel_path string, file_hash string, is_missing boolean"))
        assert {(x.page_id, x.rel_path, x.file_hash) for x in got.collect()} == want


def test_duplicates_stay_recorded(spark):
    files = spark.createDataFrame([("a.png", "X"), ("b.png", "X"), ("c.png", "X")], "rel_path string, file_hash string")
    matched = spark.createDataFrame([(7, "a.png", "X", "unchanged")], "page_id long, rel_path string, file_hash string, action string")
    recorded = spark.createDataFrame([("b.png", "old", 1), ("z.png", "Z", 2)], "rel_path string, file_hash string, canonical_page_id long")
    got = {tuple(r) for r in inventory.duplicates(files, matched, recorded).collect()}
    assert got == {("b.png", "X", 7, True), ("c.png", "X", 7, True), ("z.png", "Z", 2, False)}


def test_reviews_by_cases(spark):
    from pagewright.operators import review

    pages = spark.createDataFrame([(1, "layout_detected", False), (2, "ocr_reviewed", False), (3, "new", False), (4, "ocr_done", True), (5, "layout_detected", False), (6, "LAYOUT_REVIEWED", False)], "page_id long, status string, is_missing boolean")
    layouts = spark.createDataFrame(
        [(1, 11, "text", "2"), (1, 12, "picture", "2"), (2, 21, "text", "1"), (2, 22, "caption", "1"), (2, 23, "table", "1"), (4, 41, "text", "1"), (5, 51, "picture", "1"), (6, 61, "caption", "1"), (6, 62, "text", "1")],
        "page_id long, layout_id long, cls string, updated_at string",
    )
    outputs = spark.createDataFrame(
        [(1, 11, "footnote", "markdown", "ok", "1"), (1, 12, "picture", "skip", "skip", "3"), (2, 21, "text", "markdown", "manual", "1"), (2, 22, "caption", "markdown", "ok", "2"), (2, 23, "table", "html", "ok", "2"), (6, 61, "caption", "markdown", "failed", "2")],
        "page_id long, layout_id long, class_name string, output_format string, extraction_status string, updated_at string",
    )
    bindings = spark.createDataFrame([(22, 23), (61, 62), (61, 23)], "caption_layout_id long, target_layout_id long")
    states = {r.layout_id: r.state for r in review.judged_outputs(layouts, outputs).collect()}
    assert states == {11: "preserved", 12: "mismatch", 21: "ok", 22: "ok", 23: "ok", 41: "none", 51: "none", 61: "failed", 62: "none"}
    got = {r.page_id: (r.verdict, r.invalid, r.missing, r.next_status) for r in review.layout_reviews(pages, layouts, outputs, bindings).collect()}
    assert got == {
        1: ("accepted", 1, 0, "ocr_done"), 2: ("accepted", 0, 0, "ocr_reviewed"), 3: ("no layouts", None, None, None), 4: ("page missing", None, None, None),
        5: ("accepted", 0, 0, "layout_reviewed"), 6: ("unbound captions", None, None, None),
    }
    got = {r.page_id: r.verdict for r in review.output_reviews(pages, layouts, outputs).collect()}
    assert got == {1: "state", 2: "accepted", 3: "state", 4: "page missing", 5: "state", 6: "state"}
    ready = pages.withColumn("status", F.lit("layout_reviewed")).withColumn("is_missing", F.lit(False))
    got = {r.page_id: r.verdict for r in review.output_reviews(ready, layouts, outputs).collect()}
    assert got == {1: "open outputs", 2: "accepted", 3: "no layouts", 4: "no outputs", 5: "no outputs", 6: "failed outputs"}


def test_ascii_json_and_the_event_log(spark, tmp_path):
    from pagewright.operators import lifecycle

    rows = [("é\U0001f600", 1, None), ('a"b\\', 2, "x"), ("", None, None)]
    df = spark.createDataFrame(rows, "a string, b int, c string")
    for row, got in zip(rows, df.select(lifecycle.ascii_json(F.struct("a", "b", "c")).alias("j")).collect()):
        assert got.j == json.dumps(dict(zip("abc", row)), ensure_ascii=True, separators=(",", ":"))
    events = spark.createDataFrame([("t", "discovery", "scan", 5, "m", "ü")], "ts string, stage string, event_type string, page_id long, message string, d string")
    for _ in range(2):
        lifecycle.append_events(lifecycle.event_rows(events, F.struct("d")), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and log.first().data_json == '{"d":"\\u00fc"}'


def test_events_move_pages_once(spark):
    from pagewright.operators import lifecycle

    pages = spark.createDataFrame([(1, "new", False), (2, "new", True)], "page_id long, status string, is_missing boolean")
    events = spark.createDataFrame(
        [(4, 1, "layout_detect", "job_started", False), (5, 1, "layout_detect", "job_completed", False), (6, 2, "layout_detect", "job_completed", False), (7, 1, "layout_benchmark", "job_failed", False)],
        "id long, page_id long, stage string, event_type string, skipped boolean",
    )
    state = lambda last: ({r.page_id: (r.status, r.changed) for r in lifecycle.applied_events(pages, events, last)[0].collect()}, lifecycle.applied_events(pages, events, last)[1])
    assert state(4) == ({1: ("layout_detected", True), 2: ("new", False)}, 7)
    assert state(7) == ({1: ("new", False), 2: ("new", False)}, 7)
    assert state(99) == ({1: ("layout_detected", True), 2: ("new", False)}, 7)  # the log was begun anew
    tables = {"pages": pages, "events": events}
    left = lifecycle.without_pages(tables | {"pages": pages.withColumn("rel_path", F.lit("p"))}, pages.where("page_id = 1"))
    assert left["pages"].count() == 1 and left["events"].where("page_id IS NULL").count() == 3
    empty, counts = lifecycle.wiped(tables)
    assert empty["events"].count() == 0 and tuple(counts.first()) == (2, 4)


def test_orders_of_other_ids_are_refused(spark):
    from pagewright.operators import orders

    rows = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2)], "page_id long, layout_id long, reading_order int")
    wanted = spark.createDataFrame([(1, [11, 10, 11]), (2, [21, 20, 99])], "page_id long, ids array<long>")
    assert {(r.layout_id, r.new_order, r.changed, r.accepted) for r in orders.applied(rows, wanted).collect()} == {(10, 2, True, True), (11, 1, True, True), (20, 1, False, False), (21, 2, False, False)}
    keys = spark.createDataFrame([(x,) for x in ("p2", "P10", "p002b", "p" + "9" * 30, "p1" + "0" * 30)], "p string").select(orders.natural_key(F.col("p")).alias("k"), "p").orderBy("k").collect()
    assert [r.p for r in keys] == ["p2", "p002b", "P10", "p" + "9" * 30, "p1" + "0" * 30]


def test_headings_by_plain_rules(spark):
    """Whole contents as headings, against rules written out."""
    rows = [("# **Title**.\nmore",), ("\n\n *a* b",), ("__x__ \n",), (None,), ("   ",), ("### ",), ("plain\r\nnext",)]
    got = [r.h for r in spark.createDataFrame(rows, "c string").select(T.with_heading_level(F.col("c"), F.lit(3)).alias("h")).collect()]
    assert got == ["### Title.\nmore", "### *a* b", "### x", "", "", "### ###", "### plain\nnext"]


def test_lookalikes_of_a_line_of_two_hundred_thousand_words():
    import time

    line = "сeо word `сe` " * 70_000
    began = time.time()
    found = T._odd_words(line, None)
    assert len(found) == 70_000 and found[-1][3:5] == (len(line) - 14, len(line) - 11) and time.time() - began < 10
