"""Look-ups of words in contents, and histories of visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import bindings, creation, drafts, history, rounds, sorting
from .registry import query
from .views import frame

_TOKENS = rf"[{tokens.WORD}]+|[{tokens.SPACE}]+|[^{tokens.WORD}{tokens.SPACE}]+".replace("{", "{{").replace("}", "}}")
_PLACED = f"""t AS (SELECT layout_id, size, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM (SELECT layout_id, length(content) AS size, regexp_extract_all(content, '{_TOKENS}') AS tokens FROM {{d_outputs}})),
p AS (SELECT layout_id, size, token, sum(length(token)) OVER (PARTITION BY layout_id ORDER BY i) - length(token) AS start, CASE WHEN regexp_matches(token, '^[{tokens.WORD.replace("{", "{{").replace("}", "}}")}]') THEN 'word' WHEN regexp_matches(token, '^[{tokens.SPACE.replace("{", "{{").replace("}", "}}")}]') THEN 'space' ELSE 'punct' END AS kind FROM t)"""


@query(
    "tokens_at_offsets",
    f"""WITH {_PLACED},
c AS (SELECT *, size // 2 AS mid, start + length(token) AS stop FROM p WHERE kind <> 'space'),
d AS (SELECT *, CASE WHEN start <= mid AND mid < stop THEN 0 WHEN mid < start THEN start - mid ELSE mid - stop + 1 END AS far FROM c),
b AS (SELECT layout_id, arg_min(start, far * 1000000000 + start) AS start FROM d GROUP BY layout_id)
SELECT layout_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, token, kind FROM d JOIN b USING (layout_id, start)""",
)
def tokens_at_offsets(spark, sf):
    """The token in the middle of each output's content."""
    found = F.array_compact(F.array(tokens.token_at(F.col("content"), F.floor(F.length("content") / 2))))
    # a generator makes each token once, for the filter and all columns
    rows = frame(spark, sf, "d_outputs").select("layout_id", F.inline(found))
    return rows.select("layout_id", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), "token", "kind")


@query(
    "nearest_words",
    f"""WITH {_PLACED},
w AS (SELECT * FROM p WHERE kind = 'word'),
k AS (SELECT layout_id, arg_min(token, start) AS token FROM w GROUP BY layout_id)
SELECT layout_id, token, CAST(arg_min(start, abs(start - size * 3 // 4) * 1000000000 + start) AS BIGINT) AS place FROM w JOIN k USING (layout_id, token) GROUP BY layout_id, token""",
)
def nearest_words(spark, sf):
    """Where the first word of each content stands nearest to three quarters of it."""
    rows = frame(spark, sf, "d_outputs").select("layout_id", F.floor(F.length("content") * 3 / 4).alias("offset"), tokens.word_places("content").alias("index")).where(F.size("index") > 0)
    first = F.col("index")[0]["word"]
    return rows.select("layout_id", first.alias("token"), tokens.nearest_word(F.col("index"), first, F.col("offset")).cast("long").alias("place"))


@query("branched_histories")
def branched_histories(spark, sf):
    """Where each user stands in the pages that they visited, going back and forward at times."""
    kind = F.when(F.col("event_id") % 5 == 0, history.BACK).when(F.col("event_id") % 11 == 0, history.FORWARD).otherwise(history.VISIT)
    steps = frame(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("at"), kind.alias("kind"), (F.col("event_id") % 97 + 1).alias("page"))
    found = history.histories(steps)
    even = F.filter("history", lambda p: p % 2 == 0)
    filtered = history.allowed_only(F.col("history"), F.col("place"), even)
    return found.select(
        F.col("user").alias("user_id"), "history", F.col("place").cast("long").alias("place"), history.neighbour(F.col("history"), F.col("place"), -1).alias("previous"), history.neighbour(F.col("history"), F.col("place"), 1).alias("following"),
        filtered["place"].cast("long").alias("even_place"),
    )


def _provider():
    """A provider whose first key is used up, whose second refuses odd boxes, and which fails boxes of five."""

    def call(key, prompt):
        n = int(prompt.rsplit(" ", 1)[1])
        if key == "first":
            raise RuntimeError("429: daily quota exceeded, limit per day")
        if n % 5 == 0:
            raise RuntimeError("500 internal")
        if key == "second" and n % 2:
            raise RuntimeError("429 resource exhausted")
        return f"text of {n}"

    return call


@query(
    "extraction_rounds",
    """SELECT layout_id, CASE WHEN output_format = 'skip' THEN 'skipped' WHEN layout_id % 5 = 0 THEN 'failed' ELSE 'extracted' END AS state, CASE WHEN output_format <> 'skip' AND layout_id % 5 <> 0 THEN concat('text of ', CAST(layout_id AS VARCHAR)) END AS raw,
CASE WHEN output_format <> 'skip' AND layout_id % 5 <> 0 THEN 1 ELSE 0 END AS requests FROM {d_outputs}""",
)
def extraction_rounds(spark, sf):
    """Every output transcribed anew in rounds, by three keys of which one is used up and one refuses some boxes."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/staging"
    prompt = F.when(F.col("output_format") == "skip", "").otherwise(F.concat(F.lit("transcribe "), F.col("layout_id").cast("string")))
    crops = frame(spark, sf, "d_outputs").select("layout_id", prompt.alias("prompt"))
    return rounds.extracted(crops, _provider, ["first", "second", "third"], f"{shared}/extraction-{uuid.uuid4().hex}").select("layout_id", "state", "raw", "requests")


@query(
    "overlaid_drafts",
    """SELECT layout_id, CASE WHEN seed % 3 = 0 THEN 'table' WHEN seed % 4 = 0 THEN 'caption' ELSE cls END AS class_name, CAST(CASE WHEN seed % 5 = 0 THEN reading_order + 2 ELSE reading_order END AS BIGINT) AS reading_order,
round(CASE WHEN seed % 7 = 0 THEN x1 + 0.125 ELSE x1 END, 9) AS x1, list_filter([CASE WHEN seed % 12 = 0 AND cls <> 'table' AND cls <> 'caption' THEN 'class_name' END, CASE WHEN seed % 15 = 0 THEN 'reading_order' END], lambda v: v IS NOT NULL) AS conflicts
FROM (SELECT * FROM {d_layouts_n}) WHERE seed % 17 <> 0""",
)
def overlaid_drafts(spark, sf):
    """Drafts of boxes that were changed by others meanwhile; some boxes were taken away in the draft."""
    s = F.col("seed")
    base = frame(spark, sf, "d_layouts_n").select("layout_id", "seed", F.col("cls").alias("class_name"), F.lit("horizontal").alias("orientation"), "reading_order", "x1", "y1", "x2", "y2")
    stored = base.withColumn("class_name", F.when(s % 4 == 0, "caption").otherwise(F.col("class_name"))).withColumn("reading_order", F.when(s % 15 == 0, F.col("reading_order") + 1).otherwise(F.col("reading_order")))
    draft = base.select(
        "layout_id", F.when(s % 3 == 0, "table").otherwise(F.col("class_name")).alias("class_name"), "orientation", F.when(s % 5 == 0, F.col("reading_order") + 2).otherwise(F.col("reading_order")).alias("reading_order"),
        F.when(s % 7 == 0, F.col("x1") + 0.125).otherwise(F.col("x1") + 0.000001).alias("x1"), "y1", "x2", "y2", *[F.col(f).alias(f"base_{f}") for f in drafts.FIELDS],
    )
    out = drafts.overlaid(stored, draft, base.where(s % 17 == 0))
    return out.select("layout_id", "class_name", F.col("reading_order").cast("long").alias("reading_order"), F.round("x1", 9).alias("x1"), "conflicts")


@query("pages_by_path", "SELECT page_id, row_number() OVER (ORDER BY regexp_extract(rel_path, '^([^/]*)/', 1), page_id) AS place FROM {d_pages}")
def pages_by_path(spark, sf):
    """Places of pages in the order of their paths, in which numbers count as such: a page's number follows the folder's name."""
    from pyspark.sql import Window

    rows = frame(spark, sf, "d_pages")
    # places over the ordered ranges of a window without partitions would be one task's work: each folder is ordered for itself
    folder = F.regexp_extract("rel_path", "^([^/]*)/", 1)
    counts = rows.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("folder").orderBy(sorting.text_key(F.col("rel_path")), "page_id"))
    return rows.withColumn("folder", folder).join(F.broadcast(counts.select("folder", before.alias("before"))), "folder").select("page_id", (own + F.col("before")).alias("place"))


@query("created_boxes")
def created_boxes(spark, sf):
    """Orders of all boxes after a new one was asked for on each page: some at a place of their own, some not valid."""
    k = F.col("page_id") % 10
    x1, y1 = (F.col("page_id") * 7 % 80) / 100, (F.col("page_id") * 3 % 90) / 100
    pages = frame(spark, sf, "d_pages")
    requests = pages.select(
        F.col("page_id").alias("request_id"), "page_id", F.lit("Title").alias("class_name"), F.lit(None).cast("string").alias("orientation"), F.when(k == 3, 2).when(k == 7, 0).cast("int").alias("reading_order"),
        x1.alias("x1"), y1.alias("y1"), F.when(k == 5, x1).otherwise(x1 + 0.1).alias("x2"), (y1 + 0.05).alias("y2"),
    )
    layouts = frame(spark, sf, "d_layouts_n").select("layout_id", "page_id", "reading_order", F.col("cls").alias("class_name"), "orientation", "x1", "y1", "x2", "y2")
    out, _ = creation.created(layouts, pages, requests)
    return out.select("page_id", "layout_id", "request_id", F.col("reading_order").cast("long").alias("reading_order"), "class_name")


@query(
    "replaced_detections",
    """SELECT page_id, count(*) AS n, sum(reading_order) AS orders FROM (
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, pred_id) AS reading_order FROM (SELECT page_id, pred_id, greatest(0, x1 - 0.1) AS x1, y1, least(1, x2 - 0.1) AS x2, y2 FROM {d_predictions} WHERE cfg = 0 AND pred_id % 100 = 1) WHERE x2 > x1 AND y2 > y1 AND page_id % 2 = 0
UNION ALL SELECT page_id, reading_order FROM {d_layouts} WHERE page_id % 2 = 1) GROUP BY page_id""",
)
def replaced_detections(spark, sf):
    """Boxes after every other page was detected anew, with the first box of each page, moved beyond the edge."""
    found = frame(spark, sf, "d_predictions").where("cfg = 0 AND pred_id % 100 = 1").select("page_id", "pred_id", F.col("cls").alias("class_name"), "confidence", (F.col("x1") - 0.1).alias("x1"), "y1", (F.col("x2") - 0.1).alias("x2"), "y2")
    layouts = frame(spark, sf, "d_layouts_n").select("layout_id", "page_id", "reading_order", F.col("cls").alias("class_name"), "x1", "y1", "x2", "y2")
    pages = frame(spark, sf, "d_pages").where("page_id % 2 = 0").select("page_id")
    out = creation.with_detections(layouts, creation.cleaned(found, ["page_id"]), pages, True)
    return out.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("reading_order").alias("orders"))


_DRAFTED = "SELECT caption_layout_id, target_layout_id FROM {d_bindings} UNION ALL SELECT caption_layout_id, caption_layout_id FROM {d_bindings} UNION ALL SELECT caption_layout_id, target_layout_id + 100 FROM {d_bindings} UNION ALL SELECT caption_layout_id, caption_layout_id - 1 FROM {d_bindings}"
_KEPT = f"""k AS (SELECT c.page_id, c.layout_id AS caption_layout_id, list_sort(list(DISTINCT t.layout_id)) AS targets FROM ({_DRAFTED}) b JOIN {{d_layouts_n}} c ON c.layout_id = b.caption_layout_id AND c.cls = 'caption'
JOIN {{d_layouts_n}} t ON t.layout_id = b.target_layout_id AND t.page_id = c.page_id AND t.layout_id <> c.layout_id AND t.cls IN ('table', 'picture', 'formula') GROUP BY 1, 2)"""


def _sanitised(spark, sf):
    """Bindings with each caption bound to itself, to the box before it and to a box of another page besides."""
    b = frame(spark, sf, "d_bindings")
    c, t = F.col("caption_layout_id"), F.col("target_layout_id")
    drafted = b.select(c, F.explode(F.array(t, c, t + 100, c - 1)).alias("target_layout_id"))
    return bindings.sanitised(drafted, frame(spark, sf, "d_layouts_n").select("page_id", "layout_id", "cls"))


@query("sanitised_bindings", f"WITH {_KEPT} SELECT * FROM k")
def sanitised_bindings(spark, sf):
    return _sanitised(spark, sf)[0]


@query("unbound_captions", f"WITH {_KEPT} SELECT page_id, list_sort(list(layout_id)) AS unbound FROM {{d_layouts_n}} WHERE cls = 'caption' AND layout_id NOT IN (SELECT caption_layout_id FROM k) GROUP BY page_id")
def unbound_captions(spark, sf):
    return _sanitised(spark, sf)[1]


@query(
    "offered_configs",
    """SELECT model, CAST(image_size AS BIGINT) AS image_size, mean FROM (SELECT model, image_size, arg_min(score, result_id) AS mean, min(result_id) AS first FROM (SELECT concat('m', CAST(page_id % 5 AS VARCHAR)) AS model, 16 * (1 + page_id % 7) AS image_size, score, result_id FROM {d_results}) WHERE image_size >= 32 GROUP BY 1, 2) ORDER BY mean DESC, first LIMIT 3""",
)
def offered_configs(spark, sf):
    """The three settings that a screen offers, of rows of which the first of each setting counts."""
    rows = frame(spark, sf, "d_results").select(F.concat(F.lit(" m"), (F.col("page_id") % 5).cast("string")).alias("model"), (16 * (1 + F.col("page_id") % 7)).cast("string").alias("image_size"), F.col("score").alias("mean"), "result_id")
    return bindings.offered(rows, "result_id")
