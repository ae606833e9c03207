"""Containment search of short items in long texts by MinHash bands over overlapping windows, with DataFrame functions only.

Items are partitioned by the number of their shingle positions into classes of
powers of two. For each class, texts are cut into windows of twice the class's
size, one at every multiple of the size, so an item without insertions lies whole
in one of them. Windows and items get BANDS MinHash values, each a band of its
own; an item is a candidate for a text of which some window has one of its
values. Candidates are verified by counting the item's distinct shingles in the
whole text: exact containment, whatever is inserted into the item.

Before that, texts are reduced to shingles that some item of the class has. What
is put into an item's words then costs a window no similarity, and even if all
else in it is of other items, a window with the item has a Jaccard similarity of
0.19 or more, at which all bands miss with a chance of 4e-5; in plain text it is 0.8 and the chance 1e-33. Where insertions
deal an item over several windows, each of them is a chance: a quarter of the item
in one is missed by 1e-6. Classes of a few shingles have a band for each of an
item's shingles and miss nothing.

An item of fewer than k words is one shingle of its own length and is looked for
as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import bounded, staged


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of every k successive words; none with fewer words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


#: MinHash values of a window or item, and shingle positions up to which each shingle is a band instead.
BANDS, FEW = 48, 8


def banded(shingled: DataFrame, by: list[str]) -> DataFrame:
    """(by, size, band, value): the MinHash values of each group's shingles; shingled: by, size, h."""
    large = shingled.where(F.col("size") > FEW).groupBy(*by, "size").agg(*[F.min(F.xxhash64(F.lit(i), "h")).alias(f"v{i}") for i in range(BANDS)])
    values = F.array(*[F.col(f"v{i}") for i in range(BANDS)])
    large = large.select(*by, "size", F.posexplode(values).alias("band", "value"))
    return large.unionByName(shingled.where(F.col("size") <= FEW).select(*by, "size", F.lit(0).alias("band"), F.col("h").alias("value")))


def windows(rows: DataFrame) -> DataFrame:
    """rows, with pos and size, once for each of the two windows that they are in."""
    nth = F.floor(F.col("pos") / F.col("size"))
    return rows.withColumn("window", F.explode(F.array(nth, nth - 1)))


def contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, first_word) for each item of which the text has enough shingles.

    docs: doc_id, text; items: item_id, text. n_shingles: distinct shingles of
    the item; n_found: those that stand anywhere in the text; first_word: the
    word of the text at which the item's matches begin in the window that has
    the most of them, of several such the first. A null text has no words; an
    item without words matches nothing; rows of one doc_id or item_id are taken
    together; ids may be null.
    """
    # the outer forms of explode keep Spark from pushing a filter on the generated array, and with it the array's computation, into the scan
    own = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(k)))
    lengths = sorted(r.length for r in own.select("length").distinct().collect())  # k at most
    own = own.select("item_id", F.coalesce(*[F.when(F.col("length") == n, shingles(F.col("w"), n)) for n in lengths or [k]]).alias("h"))
    own = own.select("item_id", F.array_distinct("h").alias("item"), F.pow(F.lit(2), F.floor(F.log2(F.size("h"))) + 1).cast("long").alias("size"))
    # ids may be null or repeated, keys are neither
    own = staged(own.withColumn("key", F.xxhash64("item_id", "item", "size")).dropDuplicates(["key"]), "items")
    single = own.select("key", "size", F.explode_outer("item").alias("h"))
    vocabulary = single.groupBy("h").agg(F.collect_set("size").alias("sizes"))
    places = [F.transform(shingles(F.col("w"), n), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for n in lengths or [k]]
    found = (
        docs.select(F.struct("doc_id").alias("doc"), words(F.col("text")).alias("w"))
        .select("doc", F.explode_outer(F.concat(*places)).alias("at"))
        .select("doc", "at.pos", "at.h")
        .join(bounded(vocabulary), "h")
        .select("doc", "pos", "h", F.explode("sizes").alias("size"))
    )
    # written once: the few shingles of texts that some item has
    found = staged(found, "found")
    bands = banded(windows(found), ["doc", "window"]).select("doc", "size", "band", "value").distinct()
    candidates = bands.join(bounded(banded(single, ["key"])), ["size", "band", "value"]).select("doc", "key").distinct()
    held = found.groupBy("doc", "size", "h").agg(F.min("pos").alias("first"))
    counts = candidates.join(bounded(single), "key").hint("merge").join(held, ["doc", "size", "h"]).groupBy("doc", "key").agg(F.count("*").alias("n_found"))
    pairs = counts.join(bounded(own.select("key", "item_id", F.size("item").alias("n_shingles"))), "key").where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
    pairs = staged(pairs, "pairs")
    # the places of confirmed matches alone
    hits = windows(pairs.select("doc", "key").join(bounded(single), "key").hint("merge").join(found, ["doc", "size", "h"]))
    hits = hits.groupBy("doc", "key", "window").agg(F.count_distinct("h").alias("has"), F.min("pos").alias("first_word"))
    hits = hits.groupBy("doc", "key").agg(F.min_by("first_word", F.struct(-F.col("has"), "first_word")).alias("first_word"))
    return pairs.hint("merge").join(hits, ["doc", "key"]).groupBy(F.col("doc.doc_id").alias("doc_id"), "item_id").agg(
        F.max("n_shingles").cast("long").alias("n_shingles"), F.max("n_found").cast("long").alias("n_found"), F.min_by("first_word", F.struct(-F.col("n_found"), "first_word")).cast("long").alias("first_word")
    )
