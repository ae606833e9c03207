"""The order of the pages table: by id, path, state or date, with natural numbers, a marker for missing pages, and ids on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .orders import natural_key

#: Letters are compared by their base alone, as a list on a screen is.
COLLATION = "UNICODE_CI_AI"
DIRECTIONS = {"id": "asc", "rel_path": "asc", "status": "asc", "created_at": "desc"}
DEFAULT = "created_at"


def text_key(c: Column) -> Column:
    """Key of a text: case and accents do not count, runs of digits count as numbers."""
    return F.collate(natural_key(F.coalesce(c, F.lit(""))), COLLATION)


def page_keys(column: str) -> list[Column]:
    """Sort keys of a column, of which the first decides; an unreadable date is before all others."""
    if column == "id":
        return [F.coalesce("page_id", F.lit(0))]
    if column == "rel_path":
        return [text_key(F.col("rel_path"))]
    if column == "status":
        return [text_key(F.when(F.coalesce("is_missing", F.lit(False)), "missing").otherwise(F.lower(F.trim("status"))))]
    at = F.try_to_timestamp("created_at")
    return [at.isNotNull(), at]


def sorted_pages(pages: DataFrame, column: str | None = None, direction: str | None = None) -> DataFrame:
    """pages (page_id, rel_path, status, is_missing, created_at) in order; an unknown column or direction is the usual one. Ids rise on ties, whatever the direction."""
    column = column if column in DIRECTIONS else DEFAULT
    direction = direction if direction in ("asc", "desc") else DIRECTIONS[column]
    return pages.orderBy(*[k.desc() if direction == "desc" else k.asc() for k in page_keys(column)], F.col("page_id").asc())
