"""What a task holds at once stays bounded, with the same results."""

import re
import sys
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.catalog import ORACLES, QUERIES
from pagewright.functions import normalise as N
from pagewright.functions import raster
from pagewright.functions import text as T
from pagewright.functions import tokens
from pagewright.functions.fonts import plain_metrics
from pagewright.operators import fitting, matching, reading_order
from pagewright.plans.views import VIEWS, frame, select

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plain_joins(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_outputs_are_spread_over_tasks(spark, plain_joins):
    rows = frame(spark, SF, "d_outputs")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.5 * sum(sizes)
    assert rows.exceptAll(select(spark, SF, VIEWS["d_outputs"])).isEmpty() and select(spark, SF, VIEWS["d_outputs"]).exceptAll(rows).isEmpty()


def test_texts_of_pages_keep_open_references(spark, tmp_path):
    page = "<title>a &amp;&amp</title><p>b &lt; &copy c &amp;lt; &am</p>"
    spark.createDataFrame([(1, "u", page), (2, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["html_texts"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(c.sql(ORACLES["html_texts"]).fetchall()) and "&&amp" in got[1]
    assert spark.range(1).select(T.html_text(F.lit("a &amp b"))).first()[0] == "a & b"


def test_texts_of_pages_are_whole(spark, tmp_path):
    page = "<p>a &amp; b</p>" + "<div>word &lt; x</div>\n" * 900 + "<b>end</b> "
    spark.createDataFrame([(1, "u", page), (2, "u", "y" * 70_000)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["html_texts"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(c.sql(ORACLES["html_texts"]).fetchall())
    assert got[1].startswith("a & b\nword < x\n") and got[1].endswith("end") and len(got[1]) > 9000 and got[2] == "y" * 70_000


def test_what_composing_may_change_goes_to_python(spark):
    unsettled = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{m[1]:0>8}", T._UNSETTLED) + "]")
    second = {int(d.split()[1], 16) for d in map(unicodedata.decomposition, map(chr, range(sys.maxunicode + 1))) if d and d[0] != "<" and " " in d}
    moved = second | {c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c)))}
    assert not [hex(c) for c in moved | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)) if not unsettled.match(chr(c))]
    assert not unsettled.search("“а” é ’ ё")
    texts = ["e\u0301 “а”", "\u212b", "и\u0306", "가", "ẛ\u0323", "\U0001d15e", "plain “é”", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.nfc("t").alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: unicodedata.normalize("NFC", t or "") for i, t in enumerate(texts)}


def test_only_quotes_beside_math_go_to_python(spark):
    texts = ["‘a’ $x’$ ’", "no quote $x$", "“only”", r"\$ ’ $open ’", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    seen = df.select(T.fold_quotes_outside_math(F.col("t")).alias("f"), "t")
    assert [r.f for r in seen.collect()] == [T._fold_outside_math(t or "") for t in texts]
    assert "CASE WHEN" in seen._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1].split("]")[0]


def test_results_of_texts_are_held_in_pieces(spark):
    runs = list(T.pieces(iter([pa.array(["ab", None, "abcd", "x" * 50, "y"])]), 5))
    assert runs == [["ab", None, "abcd"], ["x" * 50], ["y"]]
    texts = ["сe x " * 20_000, "", None, "a b a", "`e` сo\nу e"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    found = T.lookalikes(df, "t", most=None).select("i", F.size("warnings").alias("n"), tokens.word_places("t").alias("p"), "warnings").orderBy("i").collect()
    assert [r.n for r in found][:5] == [len(T._odd_words(t or "", None)) for t in texts[:5]]
    assert [(w.line_index, w.token, w.normalized_token, w.token_start, w.token_end, [tuple(x) for x in w.replacements]) for w in found[4].warnings] == T._odd_words(texts[4], None)
    assert [(p.at, p.word) for p in found[3].p] == [(0, "a"), (2, "b"), (4, "a")] and len(found[0].p) == 40_000


def test_images_are_read_and_measured_together():
    rng = np.random.default_rng(5)
    kinds = [np.zeros(9, int), np.arange(7) % 3, np.full(40, 2), rng.integers(0, 5, 30), np.ones(5, int), np.r_[2, 1, 2, 2, 0, 2]]
    images = [rng.integers(0, 256, (len(k), 11, 4), np.uint8) for k in kinds]
    files = raster.encoded_together(np.concatenate(images), [len(k) for k in kinds], np.concatenate(kinds))
    assert files == [raster.encoded(px, k) for px, k in zip(images, kinds)]
    assert all((a == b).all() and (raster.decoded(f) == b).all() for a, b, f in zip(raster._decoded_together([raster._parsed(f) for f in files]), images, files))
    boxes = [[{"layout_id": 10 * i + j, "x1": 0.1 * j, "y1": 0.0, "x2": 1.2, "y2": 1.0, "bands": [{"top": 0.0, "height": 0.5}, {"top": 0.5, "height": 0.7}]} for j in range(i % 3)] for i in range(len(files))]
    kind = pa.list_(pa.struct([("layout_id", pa.int64()), *((c, pa.float64()) for c in ("x1", "y1", "x2", "y2")), ("bands", pa.list_(pa.struct([("top", pa.float64()), ("height", pa.float64())])))]))
    batch = pa.RecordBatch.from_arrays([pa.array(files, pa.binary()), pa.array(boxes, kind)], names=["content", "boxes"])
    (got,) = raster._measured(iter([batch]))
    want = [raster.line_ratios(px, (b["x1"], b["y1"], b["x2"], b["y2"]), [(x["top"], x["height"]) for x in b["bands"]]) for px, of in zip(images, boxes) for b in of]
    assert got.column(0).to_pylist() == [b["layout_id"] for of in boxes for b in of] and got.column(2).to_pylist() == want


def _plain_ratio(px, first, rows, left, columns):
    """Ink of one crop, pixel by pixel; what lies beyond the edge is clear."""
    crop = np.zeros((rows, columns, 4))
    for y in range(rows):
        for x in range(columns):
            if 0 <= first + y < px.shape[0] and 0 <= left + x < px.shape[1]:
                crop[y, x] = px[first + y, left + x]
    light, solid = crop[:, :, 0] * 0.299 + crop[:, :, 1] * 0.587 + crop[:, :, 2] * 0.114, crop[:, :, 3] >= raster.OPAQUE
    if rows < 2 or columns < 2 or not solid.any() or light[solid].max() - light[solid].min() < raster.CONTRAST:
        return None
    darkest = max(35.0, min(245.0, light[solid].mean() - raster.DISTANCE, light[solid].max() - 10))
    inked = np.flatnonzero((solid & (light <= darkest)).sum(axis=0) >= max(1, int(rows * raster.COLUMN_SHARE)))
    ratio = max(raster.LEAST_RATIO, (inked[-1] - inked[0] + 1) / columns) if len(inked) else None
    return ratio if ratio is None or ratio < raster.FULL_RATIO else 1.0


def test_equal_rows_of_images_are_looked_at_once():
    rng = np.random.default_rng(8)
    images = [np.repeat(rng.choice([30, 90, 235], (n, w, 1)), 4, axis=2).astype(np.uint8) for n, w in ((4, 10), (7, 10), (3, 6), (1, 10))]
    for px in images:
        px[:, :, 3] = np.where(rng.random(px.shape[:2]) < 0.15, 3, 255)
    images[1][:, :, 3] = 255
    images = [np.repeat(px, rng.integers(1, 5, len(px)), axis=0) for px in images]
    assert len(raster._alike([np.repeat(images[0][:1], 12, axis=0), images[0][:1]])[2]) == 1
    crops = [(int(rng.integers(len(images))), *(int(v) for v in rng.integers((0, 0, -4, 0), (20, 16, 9, 14)))) for _ in range(600)]
    got = raster._ratios(images, *(np.array(c) for c in zip(*crops)))
    want = [_plain_ratio(images[i], *crop) for i, *crop in crops]
    assert [None if np.isnan(g) else round(float(g), 12) for g in got] == [None if x is None else round(float(x), 12) for x in want] and sum(x is not None for x in want) > 200
    assert [raster.ink_ratio(px) for px in images] == [_plain_ratio(px, 0, px.shape[0], 0, px.shape[1]) for px in images]


def test_images_are_not_joined_to_their_boxes(spark, plain_joins):
    assert "Join" not in QUERIES["ink_ratios"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_boxes_are_read_once_for_their_lines(spark, plain_joins):
    plan = QUERIES["line_stretches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)) == 1


def test_boxes_are_sorted_by_what_they_are_made_of(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(300)
    # lines that agree in all or in some of the columns of the order
    others = lines.withColumn("l_discount", F.col("l_discount") + 1).withColumn("l_shipdate", F.lit(None).cast("timestamp"))
    lines.unionByName(others).unionByName(lines.withColumn("l_quantity", F.col("l_quantity") + 1)).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows, want = frame(spark, str(tmp_path), "d_layouts"), select(spark, str(tmp_path), VIEWS["d_layouts"])
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty() and rows.count() == 900
    assert "l_shipdate" not in rows._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_names_of_predictions_are_computed_once(spark):
    rows = QUERIES["normalised_predictions"](spark, SF)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4
    names = ["Title", " title ", "PICTURE-text", "Picture  Text", "a/b-c", "title\n", "x title", "", " ", None, "List  item", "İ A"]
    seen = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", N.class_core(F.col("n")).alias("c"), N.class_benchmark(F.col("n")).alias("b"), N.class_detected(F.col("n")).alias("d"))
    got = {r.i: (r.c, r.b, r.d) for r in seen.collect()}
    core = [re.sub(r"\s+", "_", (n or "").strip().lower().replace("-", "_").replace("/", "_")) for n in names]
    head = ["section_header" if c == "title" else c for c in core]
    assert got == {i: (c, None if h == "picture_text" else h, "text" if c == "list_item" else h) for i, (c, h) in enumerate(zip(core, head))}


def test_scores_shuffle_boxes_by_page_alone(spark, plain_joins):
    plan = QUERIES["class_average_precision"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(re.fullmatch(r"(l_orderkey|page_id)#\d+L", k) for k in keys)


def test_null_classes_and_settings_meet_none(spark):
    box = (0.1, 0.1, 0.6, 0.6)
    truth = spark.createDataFrame([(1, 1, "a", *box), (1, 2, "a", *box), (1, 3, None, *box), (2, 4, "b", *box)], "page_id long, layout_id long, cls string, x1 double, y1 double, x2 double, y2 double")
    rows = [(0.0, "m", 1, 1, "a", None, *box), (-0.0, "m", 1, 2, "a", 0.5, *box), (0.0, None, 1, 3, "a", 0.9, *box), (0.0, "m", 1, 4, None, 0.9, *box), (float("nan"), "m", 2, 5, "b", 0.9, *box), (0.0, "m", 3, 6, "c", 0.9, *box)]
    found = spark.createDataFrame(rows, "conf double, model string, page_id long, pred_id long, cls string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = sorted((str(r.conf), str(r.model), r.page_id, str(r.cls), r.ap50, r.ap) for r in matching.class_scores(truth, found, ["conf", "model"]).collect())
    # three settings with each class of the truth; two boxes of no class, one of a setting without a model, one of a page without truth
    want = [(c, m, p, k, float(one), float(one)) for c, m in (("0.0", "m"), ("0.0", "None"), ("nan", "m")) for p, k, one in ((1, "a", c == "0.0" and m == "m"), (1, "None", 0), (2, "b", c == "nan"))]
    want += [("0.0", "m", 1, "None", 0.0, 0.0), ("0.0", "None", 1, "a", 0.0, 0.0), ("0.0", "m", 3, "c", 0.0, 0.0)]
    assert got == sorted(want)
    assert matching.class_scores(truth, found.limit(0), ["conf", "model"]).collect() == []


def test_stored_lists_are_not_shuffled(spark):
    plan = QUERIES["stored_predictions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(re.fullmatch(r"(l_orderkey|page_id)#\d+L", k) for k in keys)


def test_orders_give_what_is_asked_for_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(p, 10 * p + k, k + 1, *(float(v) for v in (x, y, x + w, y + h))) for p in range(60) for k, (x, y, w, h) in enumerate(rng.integers(1, 9, (1 + p % 7, 4)) / 20)]
    layouts = spark.createDataFrame(rows, "page_id long, layout_id long, reading_order int, x1 double, y1 double, x2 double, y2 double")
    modes = {p: list(reading_order.ORDERS)[p // 7 % 4] for p in range(60)}
    pages = spark.createDataFrame(list(modes.items()), "page_id long, mode string")
    place = reading_order.page_orders(layouts, pages, ("place",))
    assert place.columns == ["page_id", "mode", "place"]
    new = reading_order.Item(-1, 0.4, 0.45, 0.6, 0.5)
    for r in place.collect():
        items = [reading_order.Item(i, x1, y1, x2, y2, o) for p, i, o, x1, y1, x2, y2 in rows if p == r.page_id]
        base = [i for i in items if i.width < reading_order.wide_from(items)]
        base = base if len(base) > 1 else items
        if r.mode != "multi-column" and not (r.mode == "auto" and len(base) > 1 and len(reading_order.Columns(base)) > 1):
            continue
        # the same rule over arrays
        left, right, mid, cy, order, ids = np.array([(i.x1, i.x2, i.cx, i.cy, i.order, i.id) for i in base], float).T
        sizes, apart = np.maximum(np.stack([right - left, np.full(len(left), new.width)]), 1e-6), np.abs(mid - new.cx)
        near = (np.minimum(right, new.x2) - np.maximum(left, new.x1) >= 0.2 * sizes.min(axis=0)) | (apart <= np.clip(0.7 * sizes.max(axis=0), 0.03, 0.22))
        near |= ((left <= new.cx) & (new.cx <= right)) | ((new.x1 <= mid) & (mid <= new.x2))
        near[np.lexsort((ids, cy, apart))[0]] |= not near.any()
        cy, order, ids = cy[near], order[near], ids[near]
        below = cy > new.cy
        k = np.lexsort((np.where(below, ids, -ids), np.where(below, cy, -order), np.where(below, order, -cy), below))[0]
        assert r.place == (max(1, order[k]) if below[k] else min(len(items), order[k]) + 1)


def test_names_are_canonical_before_outputs_are_judged(spark):
    plan = QUERIES["judged_outputs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan.split("Join LeftOuter")[0] and "regexp_replace" in plan
    kinds = [" OK ", "manual", "\tFAILED", "odd", "", None, "skip\n", "ok\nx", " skip"]
    got = spark.createDataFrame(list(enumerate(kinds)), "i int, s string").select("i", N.extraction_status(F.col("s")).alias("e"), N.strip(F.col("s")).alias("t")).collect()
    want = [(s or "").strip() for s in kinds]
    assert {r.i: (r.e, r.t) for r in got} == {i: (t.lower() if t.lower() in ("ok", "manual", "failed", "skip") else "ok", t) for i, t in enumerate(want)}


def test_tokens_are_found_once_and_from_the_offset(spark):
    import regex

    texts = ["", " ", "ab, cd", "a  b", "  x", "y \u3000 ", "\U0001d538b!?\U0001f600 c", "e\u0301_1--é", "\n.\t,,", "а\u00a0б", "aé\U0001f600" * 3, "x" * 200_000, "-" * 100_000 + " " * 100_000 + "y", None]
    rows = [(t, o) for t in texts for o in (*range(-1, 14), 100_000, 150_001, 10**9)]
    got = spark.createDataFrame(rows, "t string, o int").select("t", "o", tokens.token_at(F.col("t"), F.col("o")).alias("x")).collect()
    space = tokens.SPACE.replace(r"\s", r" \t\n\f\r")
    space = regex.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]:0>4}", space)
    for r in got:
        text = r.t or ""
        at = max(0, min(r.o, len(text) - 1))
        runs = [(m.start(), m.end(), m[0]) for m in regex.finditer(rf"[{tokens.WORD}]+|[^{tokens.WORD}{space}]+", text)]
        far = [(0 if a <= at < b else a - at if at < a else at - b + 1, a, b, k) for a, b, k in runs]
        want = min(far, default=None)
        kind = want and ("word" if regex.match(f"[{tokens.WORD}]", want[3]) else "punct")
        assert (r.x and tuple(r.x)) == (want and (*want[1:], kind)), (text[:20], r.o)
    plan = QUERIES["tokens_at_offsets"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 4 and "regexp_replace(" not in plan.split("Generate")[1].split("\n")[0]


def test_texts_are_fitted_by_counts_of_lines(spark):
    font, rng = plain_metrics(), np.random.default_rng(11)
    table = font.table()
    table[ord("|")] = 0
    chars = list("abWi|  \n\r\x85\u2028é\U0001f600")
    texts = ["", " ", "\n", "\r", "\n a", None, "x" * 9000, "a " * 3000] + ["".join(rng.choice(chars, int(n))) for n in rng.integers(0, 60, 300)]
    several = list(fitting.Text.several(texts, table))
    assert len(several) == len(texts)
    seen = set()
    for text, part in zip(texts, several):
        alone = fitting.Text(text or "", table)
        for limit, most in rng.integers(0, (1200, 12), (25, 2)).tolist() + [[55, 200], [10**6, 10**4]]:
            lines, cut = part.lines(limit), part.lines(limit, most)
            assert [part.text[a:b] for a, b in lines] == [alone.text[a:b] for a, b in alone.lines(limit)]
            fits = len(lines) <= most and part.widest(lines) <= limit
            assert part.fits(limit, most) == alone.fits(limit, most) == fits == (cut is not None and part.widest(cut) <= limit)
            seen.add(fits)
    assert seen == {True, False}
    assert "array_sort(" not in QUERIES["line_stretches"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
