"""Removal of pages with all that hangs on them, the event log as a sink, and events applied to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import status_of_event

#: Tables whose rows go with their page.
OWNED = ("layouts", "outputs", "jobs", "results")


def without_pages(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after pages were removed: gone has their page_id.

    Rows of a page go with it, bindings with either of their boxes, recorded
    duplicates with their canonical page or if they stand at its path; events
    stay and lose the reference. Keys of gone are few or many: joins, no lists.
    """
    ids = gone.select("page_id").distinct()
    out = {"pages": tables["pages"].join(ids, "page_id", "left_anti")}
    for name in OWNED:
        if name in tables:
            out[name] = tables[name].join(ids, "page_id", "left_anti")
    if "bindings" in tables:
        boxes = tables["layouts"].join(ids, "page_id", "left_semi").select("layout_id")
        kept = tables["bindings"]
        for side in ("caption_layout_id", "target_layout_id"):
            kept = kept.join(boxes.withColumnRenamed("layout_id", side), side, "left_anti")
        out["bindings"] = kept.select(*tables["bindings"].columns)
    if "duplicates" in tables:
        paths = tables["pages"].join(ids, "page_id", "left_semi").select("rel_path")
        kept = tables["duplicates"].join(ids.withColumnRenamed("page_id", "canonical_page_id"), "canonical_page_id", "left_anti").join(paths, "rel_path", "left_anti")
        out["duplicates"] = kept.select(*tables["duplicates"].columns)
    if "events" in tables:
        rows = tables["events"].join(ids.withColumn("__gone", F.lit(True)), "page_id", "left")
        out["events"] = rows.withColumn("page_id", F.when(F.col("__gone").isNull(), F.col("page_id"))).select(*tables["events"].columns)
    return out


def wiped(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty tables of the same columns, and one row of the counts that they had."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        counts = one if counts is None else counts.join(F.broadcast(one))  # single rows
    return {name: df.limit(0) for name, df in tables.items()}, counts


def ascii_json(value: Column) -> Column:
    """Compact JSON of a struct, map or array in ASCII alone: other characters as escapes of their UTF-16 units."""
    text = F.to_json(value, {"ignoreNullFields": "false"})
    units = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = F.array_join(F.transform(F.split(text, ""), lambda ch: F.when(ch.rlike(r"[^\x00-\x7F]"), units(ch)).otherwise(ch)), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), escaped).otherwise(text)


def event_rows(rows: DataFrame, data: Column | None = None) -> DataFrame:
    """Events as they are logged: ts, stage, event_type, page_id, message and data_json, null without data."""
    return rows.select(
        F.coalesce("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("ts"), "stage", "event_type", "page_id", "message", (F.lit(None).cast("string") if data is None else ascii_json(data)).alias("data_json")
    )


def append_events(events: DataFrame, path: str) -> None:
    """Add rows to the log at path, from where event_stream reads them."""
    events.write.mode("append").parquet(path)


def applied_events(pages: DataFrame, events: DataFrame, last_id: int) -> tuple[DataFrame, int]:
    """(pages with the states that events after the cursor imply, the new cursor).

    A log whose greatest id is below the cursor was begun anew, so all of it
    counts. Missing pages and events of the benchmark stage are left alone.
    """
    newest = events.agg(F.max("id")).first()[0]
    if not newest or newest <= 0:
        return pages.withColumn("changed", F.lit(False)), last_id
    start = 0 if newest < last_id else last_id
    new = events.where((F.col("id") > start) & (F.col("stage") != "layout_benchmark") & (F.col("page_id") > 0))
    new = new.withColumn("new_status", status_of_event(F.col("stage"), F.col("event_type"), F.col("skipped"))).where("new_status IS NOT NULL")
    last = new.groupBy("page_id").agg(F.max_by("new_status", "id").alias("new_status"))
    both = pages.join(last, "page_id", "left")
    status = F.when(F.col("is_missing") | F.col("new_status").isNull(), F.col("status")).otherwise(F.col("new_status"))
    out = both.withColumn("changed", status != F.col("status")).withColumn("status", status)
    return out.select(*pages.columns, "changed"), max(start, newest)
