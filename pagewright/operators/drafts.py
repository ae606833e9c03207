"""Drafts laid over stored boxes: a merge of each field from what the draft began with, what is stored now, and the draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("class_name", "orientation", "reading_order", "x1", "y1", "x2", "y2")
PLACES = 4  # decimals to which coordinates count


def _same(a: Column, b: Column, field: str) -> Column:
    if field in FIELDS[:2]:
        a, b = (F.lower(F.trim(x)) for x in (a, b))
    elif field != "reading_order":
        a, b = F.round(a, PLACES), F.round(b, PLACES)
    return a.eqNullSafe(b)


def overlaid(stored: DataFrame, drafts: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Stored boxes with their drafts: layout_id, FIELDS, drafted, conflicts (names of fields).

    stored: layout_id and FIELDS; drafts: layout_id, FIELDS as the user has them,
    and base_ with each name as they were when the draft was begun; removed:
    layout_ids that the user took away. A field that the draft changed has its
    value; one that it left alone keeps what is stored by now. Both changed, to
    different values, is a conflict, in which the draft stays on view. Drafts of
    boxes that are gone have no row.
    """
    d = drafts.select("layout_id", *[F.col(f).alias(f"draft_{f}") for f in FIELDS], *[f"base_{f}" for f in FIELDS], F.lit(True).alias("drafted"))
    rows = stored.join(d, "layout_id", "left")
    if removed is not None:
        rows = rows.join(removed.select("layout_id"), "layout_id", "left_anti")
    drafted = F.coalesce("drafted", F.lit(False))
    columns, conflicts = [], []
    for f in FIELDS:
        now, draft, base = F.col(f), F.col(f"draft_{f}"), F.col(f"base_{f}")
        changed = drafted & ~_same(draft, base, f)
        columns.append(F.when(changed, draft).otherwise(now).alias(f))
        conflicts.append(F.when(changed & ~_same(now, base, f) & ~_same(now, draft, f), F.lit(f)))
    return rows.select("layout_id", *columns, drafted.alias("drafted"), F.array_compact(F.array(*conflicts)).alias("conflicts"))
