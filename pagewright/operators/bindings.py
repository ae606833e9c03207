"""Captions and what they are bound to, and the settings that a screen offers first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes that a caption can be bound to.
TARGETS = ("table", "picture", "formula")
MOST_OFFERED, LEAST_SIZE = 3, 32


def sanitised(bindings: DataFrame, layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((page_id, caption_layout_id, targets), (page_id, unbound)) of bindings as a draft has them.

    bindings: caption_layout_id, target_layout_id, with repeats and nulls;
    layouts: page_id, layout_id, cls. A target is kept if it stands on the
    caption's page, is of a class that has captions and is not the caption
    itself; targets and the captions of a page without any are in order of id.
    """
    captions = layouts.where("cls = 'caption'").select("page_id", F.col("layout_id").alias("caption_layout_id"))
    targets = layouts.where(F.col("cls").isin(*TARGETS)).select("page_id", F.col("layout_id").alias("target_layout_id"))
    good = bindings.where("caption_layout_id <> target_layout_id").join(captions, "caption_layout_id").join(targets, ["page_id", "target_layout_id"])
    kept = good.groupBy("page_id", "caption_layout_id").agg(F.sort_array(F.collect_set("target_layout_id")).alias("targets"))
    free = captions.join(kept.select("caption_layout_id"), "caption_layout_id", "left_anti")
    return kept, free.groupBy("page_id").agg(F.sort_array(F.collect_list("caption_layout_id")).alias("unbound"))


def offered(rows: DataFrame, order: str, most: int = MOST_OFFERED) -> DataFrame:
    """(model, image_size, mean) of the settings that a screen offers: the first row of each, in the given order, then the best of those.

    rows: model, image_size (a number or a text), mean. A row without a model, or
    whose size is no whole number of 32 or more, does not count; a mean that is no
    number is 0. Ties stand in the order in which they were first seen.
    """
    size = F.col("image_size").cast("string").try_cast("double")
    mean = F.col("mean").try_cast("double")
    usable = rows.withColumn("model", F.trim("model")).withColumn("image_size", size).where((F.coalesce("model", F.lit("")) != "") & (F.col("image_size") >= LEAST_SIZE) & (F.col("image_size") == F.floor("image_size")))
    usable = usable.withColumn("mean", F.when(mean.isNull() | F.isnan(mean) | (F.abs(mean) == float("inf")), 0.0).otherwise(mean))
    first = usable.groupBy("model", "image_size").agg(F.min_by("mean", order).alias("mean"), F.min(order).alias("__first"))
    return first.orderBy(F.desc("mean"), "__first").limit(most).select("model", F.col("image_size").cast("long").alias("image_size"), "mean")
