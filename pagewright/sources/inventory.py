"""Inventory of page files: scan, canonical copies, and reconciliation with the pages that are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import written

# Fixed value: suffixes of page images.
SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff")


def parse_suffixes(raw: str) -> tuple[str, ...]:
    """Comma-separated suffixes in lower case with their dot; the default if there are none."""
    found = dict.fromkeys(x if x.startswith(".") else f".{x}" for x in (p.strip().lower() for p in raw.split(",")) if x)
    return tuple(found) or SUFFIXES


def with_known_suffix(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files by suffix in any case; a name that is a suffix alone has none."""
    return files.where(F.lower(F.regexp_extract("rel_path", r"[^/](\.[^./]+)$", 1)).isin(*suffixes))


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(rel_path, file_hash) of all page files below a folder that Spark can read; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rel = F.substring(path, len(base) + 1, 1 << 30)
    return with_known_suffix(files.select(rel.alias("rel_path"), F.sha2("content", 256).alias("file_hash")), suffixes)


#: Changed files that are read by their names; if there are more, all files are read once.
MOST_NAMED = 10_000


def _listed(spark: SparkSession, root: str, suffixes: tuple[str, ...], paths: list[str] | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.load(paths) if paths else reader.load(root)
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rel = F.substring(F.regexp_replace("path", r"^[a-z]+:/*", "/"), len(base) + 1, 1 << 30)
    return with_known_suffix(files.withColumn("rel_path", rel), suffixes)


def rescan(spark: SparkSession, root: str, recorded: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, int]:
    """((rel_path, length, modified, file_hash) of all page files below a folder, how many of them were read).

    recorded: what the last scan gave. A file of the same name, length and time
    of change keeps its recorded hash and is not opened: the listing of a folder
    reads no contents. Files that are not there any more have no row.
    """
    columns = ["rel_path", "length", "modified"]
    there = _listed(spark, root, suffixes).select("path", "rel_path", "length", F.col("modificationTime").alias("modified"))
    new = written(there.join(recorded.select(*columns), columns, "left_anti"))
    names = [r.path for r in new.select("path").limit(MOST_NAMED + 1).collect()]
    kept = there.join(recorded.select(*columns, "file_hash"), columns).select(*columns, "file_hash")
    if not names:
        return kept, 0
    contents = _listed(spark, root, suffixes, names if len(names) <= MOST_NAMED else None)
    hashed = contents.select("rel_path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"))
    if len(names) > MOST_NAMED:
        hashed = hashed.join(new.select("rel_path"), "rel_path", "left_semi")
    return kept.unionByName(hashed), new.count() if len(names) > MOST_NAMED else len(names)


def canonical(files: DataFrame) -> DataFrame:
    """Each file with the least path of its content: that copy is the canonical one."""
    same = Window.partitionBy("file_hash")
    first = F.min("rel_path").over(same)
    return files.select("rel_path", "file_hash", (F.col("rel_path") == first).alias("canonical"), first.alias("first_path"))


def _taken(found: DataFrame, known: DataFrame) -> DataFrame:
    """file_hash of the files that no page answers to by content when their turn comes.

    Files are taken in order of their hashes. A file without a page of its hash
    takes over the page that stands at its path, if it comes before the file of
    that page's own hash; that file then is without a page itself, and so on up
    the order. Each round follows all such steps at once.
    """
    at = known.select("rel_path", F.col("file_hash").alias("page_hash"))
    step = found.join(at, "rel_path").where("file_hash < page_hash").select("file_hash", F.col("page_hash").alias("next_hash"))
    step = written(step.join(found.select(F.col("file_hash").alias("next_hash")), "next_hash", "left_semi"))
    out = front = written(found.select("file_hash").join(known.select("file_hash"), "file_hash", "left_anti"))
    # hashes only rise along a chain, so none is met twice by one, and each round is as short as its front
    while not (front := written(front.join(step, "file_hash").select(F.col("next_hash").alias("file_hash")).distinct())).isEmpty():
        out = out.unionByName(front)
    return out.distinct()


def reconcile(found: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, rel_path, file_hash, action) for each canonical file and each page that was not found.

    Files are matched one after the other in order of their hashes: by content
    (renamed, revived, unchanged), else by path (rehashed) if a page is still
    there, which has not been renamed before; else they are inserted with a null
    id. Hashes and paths of found and of known are distinct.
    """
    by_hash = known.select("file_hash", F.col("page_id").alias("h_id"), F.col("rel_path").alias("h_path"), F.col("is_missing").alias("h_missing"))
    without = _taken(found, known).withColumn("without", F.lit(True))
    own = found.select(F.col("file_hash").alias("p_hash"), F.lit(True).alias("p_found"))
    by_path = known.select("rel_path", F.col("page_id").alias("p_id"), F.col("file_hash").alias("p_hash")).join(own, "p_hash", "left")
    rows = found.join(by_hash, "file_hash", "left").join(without, "file_hash", "left").join(by_path, "rel_path", "left")
    mine = F.col("h_id").isNotNull() & F.col("without").isNull()
    # a page whose own file came before has been matched by it and has left the path
    there = F.col("p_id").isNotNull() & (F.col("p_found").isNull() | (F.col("p_hash") > F.col("file_hash")))
    action = (
        F.when(mine & (F.col("h_path") != F.col("rel_path")), "renamed")
        .when(mine & F.col("h_missing"), "revived")
        .when(mine, "unchanged")
        .when(there, "rehashed")
        .otherwise("inserted")
    )
    matched = rows.select(F.when(mine, F.col("h_id")).when(there, F.col("p_id")).alias("page_id"), "rel_path", "file_hash", action.alias("action"))
    seen = matched.where("page_id IS NOT NULL").select("page_id")
    gone = known.where("NOT is_missing").join(seen, "page_id", "left_anti").select("page_id", "rel_path", "file_hash", F.lit("missing").alias("action"))
    return matched.unionByName(gone)


def duplicates(files: DataFrame, matched: DataFrame, recorded: DataFrame) -> DataFrame:
    """(rel_path, file_hash, canonical_page_id, active) after a scan.

    files: all that were found; matched: what reconcile gave, with the ids of
    inserted pages where they are known; recorded: duplicates of scans before,
    which stay, inactive, if they were not found again.
    """
    pages = matched.where("action <> 'missing'").select("file_hash", F.col("page_id").alias("canonical_page_id"))
    now = canonical(files).where("NOT canonical").select("rel_path", "file_hash").join(pages, "file_hash").select("rel_path", "file_hash", "canonical_page_id", F.lit(True).alias("active"))
    old = recorded.join(now.select("rel_path"), "rel_path", "left_anti").select("rel_path", "file_hash", "canonical_page_id", F.lit(False).alias("active"))
    return now.unionByName(old)
