"""Whether a better setting may be applied by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PAGES, LEAST_GAIN, NEWEST = 10, 0.025, 2


def auto_apply(scores: DataFrame, pages: DataFrame, baseline: int) -> DataFrame:
    """One row (best, decision); scores: page_id, cfg, score; pages: page_id, updated_at.

    The gates, in order: the baseline has scores; there are enough pages; the
    best is another setting; it gains enough; it is better on each newest page.
    """
    means = scores.groupBy("cfg").agg(F.round(F.avg("score"), 9).alias("mean"))
    best = means.agg(F.max_by("cfg", F.struct("mean", -F.col("cfg"))).alias("best"), F.max("mean").alias("mean"), F.max(F.when(F.col("cfg") == baseline, F.col("mean"))).alias("base"))
    count = pages.agg(F.count("*").alias("n"))
    newest = pages.orderBy(F.desc("updated_at"), "page_id").limit(NEWEST).select("page_id")
    one = F.lit(1).alias("one")
    # single rows and two pages are broadcast
    wide = F.broadcast(newest).join(scores, "page_id", "left").select("page_id", "cfg", "score", one).join(F.broadcast(best.select("best", one)), "one")
    per_page = wide.groupBy("page_id").agg(F.coalesce(F.max(F.when(F.col("cfg") == F.col("best"), F.col("score"))), F.lit(-1.0)).alias("b"), F.coalesce(F.max(F.when(F.col("cfg") == baseline, F.col("score"))), F.lit(-1.0)).alias("z"))
    stable = per_page.agg(F.bool_and(F.col("b") > F.col("z")).alias("stable"))
    row = best.select("*", one).join(F.broadcast(count.select("n", one)), "one").join(F.broadcast(stable.select("stable", one)), "one")
    gain = F.when(F.col("base") > 0, (F.col("mean") - F.col("base")) / F.col("base")).otherwise(F.when(F.col("mean") > F.col("base"), 1.0).otherwise(0.0))
    decision = (
        F.when(F.col("base").isNull(), "no baseline").when(F.col("n") < LEAST_PAGES, "too few pages").when(F.col("best") == baseline, "already best").when(gain < LEAST_GAIN, "gain too small").when(~F.col("stable"), "not stable").otherwise("apply")
    )
    return row.select("best", decision.alias("decision"))
