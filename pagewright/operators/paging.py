"""Keyset pagination and its opaque cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = ("id", "rel_path", "status", "created_at")


def page_after(df: DataFrame, key: str, tie: str, descending: bool = False, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """The rows behind a cursor in key order, one more than the limit, so the caller sees whether more follow."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be within 1 and 200")
    if after is not None:
        k, t = F.col(key), F.col(tie)
        v, i = map(F.lit, after)
        df = df.where((k < v) | ((k == v) & (t < i)) if descending else (k > v) | ((k == v) & (t > i)))
    order = [F.desc(c) if descending else F.asc(c) for c in (key, tie)]
    return df.orderBy(*order).limit(limit + 1)


def all_pages(df: DataFrame, key: str, tie: str, limit: int = 200):
    """Follow the cursors to the end, a bounded page at a time.

    A loop of a client, for as many rows as a screen can hold: each page sorts what is left of the table.
    """
    after = None
    while True:
        rows = page_after(df, key, tie, after=after, limit=limit).collect()
        yield from rows[:limit]
        if len(rows) <= limit:
            return
        after = (rows[limit - 1][key], rows[limit - 1][tie])


def cursor(sort: str, direction: str, value: Column, tie: Column) -> Column:
    """Unpadded URL-safe base64 of the sort, the direction, and the last row's key and id."""
    text = F.concat(F.lit(f'{{"s":"{sort}","d":"{direction}","v":'), F.to_json(F.array(value)), F.lit(',"i":'), tie.cast("string"), F.lit("}"))
    text = F.regexp_replace(text, r'"v":\[(.*)\],"i":', '"v":$1,"i":')
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decoded(c: Column, sort: str, direction: str) -> Column:
    """The parts of a cursor; null if it is not valid, has no positive id or belongs to another order."""
    padded = F.concat(c, F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4))))
    raw = F.try_to_binary(F.translate(padded, "-_", "+/"), F.lit("base64"))
    parts = F.from_json(F.decode(raw, "UTF-8"), "s string, d string, v string, i long")
    return F.when((parts["s"] == sort) & (parts["d"] == direction) & (parts["i"] > 0), parts)
