"""Review rules over layouts and their outputs, and the page states that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N

# Fixed value: states of a page whose outputs may be marked reviewed, as they are stored.
REVIEWABLE = ("layout_reviewed", "ocr_done", "ocr_reviewed", "ocr_failed")


def judged_outputs(layouts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(page_id, layout_id, cls, needed, state) for each layout: none, failed, preserved, mismatch, stale or ok.

    An output of another class is preserved, whatever its age, where both
    classes are written as markdown. layouts: cls, updated_at; timestamps are
    texts of one form.
    """
    # names are made canonical once for each row, before the join
    o = outputs.select(
        "layout_id", N.class_core(F.col("class_name")).alias("o_class"), F.lower(N.strip(F.col("output_format"))).alias("o_format"), N.extraction_status(F.col("extraction_status")).alias("o_status"), F.col("updated_at").alias("o_at")
    )
    rows = layouts.withColumn("__core", N.class_core(F.col("cls"))).join(o, "layout_id", "left")
    state = (
        F.when(F.col("o_status").isNull(), "none")
        .when(F.col("o_status") == "failed", "failed")
        .when(N.cores_match(F.col("o_class"), F.col("o_format"), F.col("__core")), F.when(F.col("updated_at") > F.col("o_at"), "stale").otherwise("ok"))
        .when(N.cores_preserve(F.col("o_class"), F.col("__core"), F.col("o_format")), "preserved")
        .otherwise("mismatch")
    )
    return rows.select("page_id", "layout_id", "cls", N.requires_text(F.col("cls")).alias("needed"), state.alias("state"))


def layout_reviews(pages: DataFrame, layouts: DataFrame, outputs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per page: whether its layout may be marked reviewed, and if so how many outputs go and the state that follows.

    Captions need a target of their page. Outputs that failed, do not fit or are
    stale go; a page with all that it needs stays or becomes done, where it
    needs something at all.
    """
    bound = binding_errors(layouts, bindings).where("bound").select(F.col("caption_layout_id").alias("layout_id"), F.lit(True).alias("bound"))
    rows = judged_outputs(layouts, outputs).join(bound, "layout_id", "left")
    usable = F.col("state").isin("ok", "preserved")
    sums = rows.groupBy("page_id").agg(
        F.count("*").alias("n_layouts"),
        F.count_if((F.col("cls") == "caption") & F.col("bound").isNull()).alias("unbound"),
        F.count_if(F.col("state").isin("failed", "mismatch", "stale")).alias("invalid"),
        F.count_if(F.col("needed") & ~usable).alias("missing"),
        F.count_if("needed").alias("needed"),
    )
    both = pages.join(sums, "page_id", "left").withColumn("n_layouts", F.coalesce("n_layouts", F.lit(0)))
    verdict = F.when(F.col("is_missing"), "page missing").when(F.col("n_layouts") == 0, "no layouts").when(F.col("unbound") > 0, "unbound captions").otherwise("accepted")
    now = N.status_lower(F.col("status"))
    following = F.when(F.col("missing") > 0, "layout_reviewed").when(now.isin("ocr_reviewed", "ocr_done"), now).when(F.col("needed") > 0, "ocr_done").otherwise("layout_reviewed")
    counts = [F.when(F.col("verdict") == "accepted", F.col(c)).alias(c) for c in ("invalid", "missing")]
    return both.withColumn("verdict", verdict).select("page_id", "verdict", "n_layouts", *counts, F.when(F.col("verdict") == "accepted", following).alias("next_status"))


def output_reviews(pages: DataFrame, layouts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per page: whether its outputs may be marked reviewed, and if not, why; an output of another class does not count."""
    o = outputs.select("layout_id", F.col("class_name").alias("o_class"), F.col("output_format").alias("o_format"), N.extraction_status(F.col("extraction_status")).alias("o_status"))
    fits = N.output_matches(F.col("o_class"), F.col("o_format"), F.col("cls")) & F.col("o_status").isin("ok", "manual")
    needed = N.requires_text(F.col("cls"))
    sums = layouts.join(o, "layout_id", "left").groupBy("page_id").agg(
        F.count("*").alias("n_layouts"), F.count_if(needed & (F.col("o_status") == "failed")).alias("failed"), F.count_if(needed & ~F.coalesce(fits, F.lit(False))).alias("open")
    )
    made = outputs.groupBy("page_id").agg(F.count("*").alias("n_outputs"))
    both = pages.join(sums, "page_id", "left").join(made, "page_id", "left")
    verdict = (
        F.when(F.col("is_missing"), "page missing")
        .when(~F.col("status").isin(*REVIEWABLE), "state")
        .when(F.col("n_layouts").isNull(), "no layouts")
        .when(F.col("n_outputs").isNull(), "no outputs")
        .when(F.col("failed") > 0, "failed outputs")
        .when(F.col("open") > 0, "open outputs")
        .otherwise("accepted")
    )
    return both.select("page_id", "status", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("open", F.lit(0)).alias("open"), verdict.alias("verdict"))


def binding_errors(layouts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Captions without a valid target of their page, sorted ids of the targets that are valid."""
    caption = layouts.where("cls = 'caption'").select(F.col("layout_id").alias("caption_layout_id"), "page_id")
    target = layouts.where(F.col("cls").isin(*N.CAPTION_TARGETS)).select(F.col("layout_id").alias("target_layout_id"), F.col("page_id").alias("t_page"))
    valid = bindings.join(target, "target_layout_id")
    rows = caption.join(valid, (caption["caption_layout_id"] == valid["caption_layout_id"]) & (caption["page_id"] == valid["t_page"]), "left")
    return rows.groupBy("page_id", caption["caption_layout_id"]).agg(F.array_sort(F.collect_set("target_layout_id")).alias("targets")).withColumn("bound", F.size("targets") > 0)
