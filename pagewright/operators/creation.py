"""New boxes of pages: asked for by a user, or found by a detector and cleaned."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import normalise as N
from .matching import without_overlaps
from .reading_order import Item, insertion_place, pages_of

_NEW = 1 << 60  # ids of boxes of the same run come after all others


def _placed(items: list[Item], requests: list[dict], mode: str) -> list[tuple]:
    """Orders of a page's boxes after its requests, one after another; orders are closed up first."""
    asked: dict[int, int] = {}
    for r in requests:
        items = [Item(x.id, x.x1, x.y1, x.x2, x.y2, k + 1) for k, x in enumerate(items)]
        own = r["reading_order"]
        at = insertion_place(items, Item(-1, r["x1"], r["y1"], r["x2"], r["y2"]), mode) if own is None else own
        new = Item(_NEW + r["request_id"], r["x1"], r["y1"], r["x2"], r["y2"])
        asked[new.id] = r["request_id"]
        items.insert(min(at, len(items) + 1) - 1, new)
    return [(None if x.id in asked else x.id, asked.get(x.id), k + 1) for k, x in enumerate(items)]


def _page_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        boxes, requests, mode = batch.columns
        rows = [row for page in zip(pages_of(boxes), requests.to_pylist(), mode.to_pylist()) for row in _placed(*page)]
        columns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], names=["layout_id", "request_id", "reading_order"])


def refused(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """requests with why each is refused, else null: a bad box, an order below one, or no page that may be edited."""
    known = requests.join(pages.select("page_id", F.coalesce("is_missing", F.lit(False)).alias("__missing")), "page_id", "left")
    error = F.coalesce(
        F.when(F.col("__missing").isNull(), "page not found").when(F.col("__missing"), "page is missing"), G.box_error(G.box()), F.when(F.col("reading_order") < 1, "order below one"), F.when(F.coalesce(F.trim("class_name"), F.lit("")) == "", "no class")
    )
    return known.withColumn("error", error).drop("__missing")


def created(layouts: DataFrame, pages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layouts with the new boxes, page_id and new status of the pages that have any).

    layouts: layout_id, page_id, reading_order, class_name, orientation, box;
    requests: request_id, page_id, class_name, box, reading_order and orientation,
    both of which may be null: then the place follows from the page's order mode,
    and the orientation from the box. New rows have a null layout_id and their
    request_id. Requests of a page are taken one after the other, by id; what
    `refused` gives a reason for is left out. A page's boxes meet in one row.
    """
    good = refused(pages, requests).where("error IS NULL")
    box = lambda *more: F.struct(*more, "x1", "y1", "x2", "y2")
    asked = good.groupBy("page_id").agg(F.array_sort(F.collect_list(box("request_id", "reading_order"))).alias("requests"))
    have = layouts.join(asked.select("page_id"), "page_id").groupBy("page_id").agg(F.array_sort(F.collect_list(box("reading_order", "layout_id"))).alias("boxes"))
    none = F.array().cast("array<struct<reading_order:int,layout_id:bigint,x1:double,y1:double,x2:double,y2:double>>")
    rows = asked.join(have, "page_id", "left").join(pages.select("page_id", N.order_mode(F.col("order_mode")).alias("mode")), "page_id")
    rows = rows.select(F.coalesce("boxes", none).alias("boxes"), "requests", "mode").mapInArrow(_page_orders, "layout_id long, request_id long, reading_order int")
    moved = rows.where("layout_id IS NOT NULL").select("layout_id", F.col("reading_order").alias("__order"))
    columns = ["layout_id", "page_id", "reading_order", "class_name", "orientation", "x1", "y1", "x2", "y2", "request_id"]
    old = layouts.join(moved, "layout_id", "left").withColumn("reading_order", F.coalesce("__order", F.col("reading_order").cast("int"))).withColumn("request_id", F.lit(None).cast("long"))
    orientation = F.when(F.col("orientation").isNull(), G.inferred_orientation(G.box())).otherwise(N.orientation(F.col("orientation")))
    new = good.drop("reading_order", "error").join(rows.where("request_id IS NOT NULL").select("request_id", "reading_order"), "request_id")
    new = new.withColumn("orientation", orientation).withColumn("class_name", N.class_persisted(F.col("class_name"))).withColumn("layout_id", F.lit(None).cast("long"))
    return old.select(*columns).unionByName(new.select(*columns)), asked.select("page_id", F.lit("layout_detected").alias("status"))


def cleaned(found: DataFrame, keys: list[str], name: Column | None = None) -> DataFrame:
    """Rows of a detector as they are stored: keys, pred_id, class_name, confidence, box, place (1 from the top left).

    found: keys, pred_id, class_name, confidence and box, which may reach beyond
    the image. Boxes are kept within it, empty ones and those without a class
    dropped; classes have their stored names; of boxes that cover each other the
    surer stays; rows are placed by their top edge, then the left one.
    """
    b = dict(zip(("x1", "y1", "x2", "y2"), (G.clamp(c) for c in G.box())))
    rows = found.withColumns(b).where("x2 > x1 AND y2 > y1").where(F.trim("class_name") != "")
    rows = rows.select(*keys, "pred_id", N.class_detected(F.col("class_name")).alias("cls"), "confidence", "x1", "y1", "x2", "y2")
    kept = without_overlaps(rows, keys).join(rows.select(*keys, "pred_id", "confidence"), [*keys, "pred_id"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("y1", "x1", "pred_id"))  # boxes of a page
    return kept.select(*keys, "pred_id", F.col("cls").alias("class_name"), "confidence", "x1", "y1", "x2", "y2", place.alias("place"))


def with_detections(layouts: DataFrame, found: DataFrame, pages: DataFrame, replace_old: bool) -> DataFrame:
    """layouts (layout_id, page_id, reading_order, class_name, box) after a detection run over pages (page_id).

    found: page_id, class_name, box and place, as `cleaned` gives it. The boxes
    of those pages go, also where nothing was found, or new ones are put behind
    them. New rows have a null layout_id.
    """
    own = layouts.select("layout_id", "page_id", F.col("reading_order").cast("int").alias("reading_order"), "class_name", "x1", "y1", "x2", "y2")
    if replace_old:
        own, start = own.join(pages.select("page_id"), "page_id", "left_anti"), None
    else:
        start = own.groupBy("page_id").agg(F.max("reading_order").alias("__last"))
    new = found.join(pages.select("page_id"), "page_id", "left_semi")
    new = new.withColumn("__last", F.lit(0)) if start is None else new.join(start, "page_id", "left")
    new = new.select(F.lit(None).cast("long").alias("layout_id"), "page_id", (F.col("place") + F.coalesce("__last", F.lit(0))).cast("int").alias("reading_order"), "class_name", "x1", "y1", "x2", "y2")
    return own.select(*new.columns).unionByName(new)
