"""The exported dataset: one JSON line a page with its items nested in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import EXPORT_STATUSES


def nested_pages(pages: DataFrame, layouts: DataFrame, outputs: DataFrame, bindings: DataFrame) -> DataFrame:
    """(page_id, image, items) of live, fully reviewed pages; an item's content is null for a picture, its targets for all but captions."""
    live = pages.where(~F.col("is_missing") & F.col("status").isin(*EXPORT_STATUSES)).select("page_id", F.col("rel_path").alias("image"))
    targets = bindings.groupBy(F.col("caption_layout_id").alias("layout_id")).agg(F.array_sort(F.collect_set("target_layout_id")).alias("targets"))
    rows = live.join(layouts, "page_id").join(outputs.select("layout_id", "content", "output_format"), "layout_id", "left").join(targets, "layout_id", "left")
    shown = F.col("cls") != "picture"
    item = F.struct(
        F.col("reading_order").alias("order"),
        F.col("layout_id"),
        F.struct("x1", "y1", "x2", "y2").alias("bbox"),
        F.col("cls").alias("class_name"),
        F.when(shown, F.col("output_format")).alias("content_format"),
        F.when(shown, F.col("content")).alias("content"),
        F.when(F.col("cls") == "caption", F.col("targets")).alias("caption_targets"),
    )
    return rows.groupBy("page_id", "image").agg(F.array_sort(F.collect_list(item)).alias("items"))


def write_dataset(pages: DataFrame, path: str) -> None:
    """Write nested pages as JSON lines; fields that are null are left out."""
    pages.write.mode("overwrite").json(path)


def prompt_rows(layouts: DataFrame, prompts: DataFrame) -> DataFrame:
    """(page_id, layout_id, class_name, reading_order, output_format, prompt), as the prompt dump writes it; prompts are one row a class."""
    return layouts.join(F.broadcast(prompts), "cls").select("page_id", "layout_id", F.col("cls").alias("class_name"), "reading_order", "output_format", "prompt")  # a row for each of eleven classes
