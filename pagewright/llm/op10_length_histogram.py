"""Exact length histogram of encoded documents.

Documents are aggregated by encoded length, within each batch first, so what is
shuffled grows with the number of distinct lengths. Suffix sums over lengths
then answer totals, quantiles and truncated totals for every context limit: of
a limit L, the row of the least length of L or more gives the documents and
tokens at or above it.

Suffix sums are taken in two levels, within blocks of lengths and over the
blocks, so no task sees all lengths.

Defined results: a null or empty text has length 0; ids are not looked at, so
rows with null or repeated ids count each; an empty table gives an empty
histogram; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import staged, typed
from .encoding import default_vocabulary, encoded

NAME = "op10_length_histogram"
BLOCK = 1024


def _lengths(batches, path: str):
    for batch in batches:
        n = np.fromiter((len(ids) for ids in encoded(batch.column(0), path)), np.int64, len(batch))
        length, docs = np.unique(n, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(docs.astype(np.int64))], names=["length", "n_docs"])


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(length, n_docs) over all documents."""
    path = vocabulary or default_vocabulary()
    counts = typed(docs, text="string").mapInArrow(lambda it: _lengths(it, path), "length long, n_docs long")
    return counts.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each length with docs_at_least, tokens_at_least, and the totals n_docs_all, n_tokens_all.

    truncated_tokens: what remains of all documents when each is cut at this
    length; share_at_most: the share of documents of at most this length.
    """
    rows = histogram.withColumn("block", F.floor(F.col("length") / block))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row for each block of lengths: bounded by the longest document, not by their number
    sums = sums.select(
        "block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("n_docs_all"), F.sum("t").over(whole).alias("n_tokens_all"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum(F.col("n_docs") * F.col("length")).over(within))
    rows = rows.join(sums, "block").withColumn("docs_at_least", F.col("d") + F.col("d_above")).withColumn("tokens_at_least", F.col("t") + F.col("t_above"))
    return rows.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least", "n_docs_all", "n_tokens_all",
        (F.col("n_tokens_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("n_docs_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("n_docs_all")).alias("share_at_most"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents longer than it, tokens kept when each document is cut there, and tokens lost."""
    wanted = sums.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit"))
    total = sums.agg(F.max("n_tokens_all").alias("total"), F.max("n_docs_all").alias("docs"))
    next_ = F.broadcast(wanted).join(sums, F.col("length") > F.col("limit")).groupBy("limit").agg(F.max_by("docs_at_least", -F.col("length")).alias("d"), F.max_by("tokens_at_least", -F.col("length")).alias("t"))
    out = wanted.join(next_, "limit", "left").withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0))
    kept = F.col("total") - t + F.col("limit") * d
    return out.select("limit", d.alias("docs_longer"), kept.alias("tokens_kept"), (F.col("total") - kept).alias("tokens_lost"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length that at least that share of the documents does not exceed."""
    wanted = sums.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return F.broadcast(wanted).join(sums, F.col("share_at_most") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once: the sums read the histogram twice
    return with_suffix_sums(staged(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")), "histogram"))


QUERIES = {NAME: query}
