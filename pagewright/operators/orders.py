"""Edits of reading orders, which run from 1 without gaps on each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moved(rows: DataFrame, page: str, order: str, source: int, target: int) -> DataFrame:
    """The row at one place of each page moves to another, at most the last; those between close up. Adds new_order."""
    if target < 1:
        raise ValueError("orders begin at 1")
    last = F.max(order).over(Window.partitionBy(page))
    o, to = F.col(order), F.least(F.lit(target), last)
    new = F.when(o == source, to).when((o > source) & (o <= to), o - 1).when((o >= to) & (o < source), o + 1).otherwise(o)
    return rows.withColumn("new_order", new)


def shifted(order: Column, inserted: int) -> Column:
    """Orders after one was inserted before them."""
    return F.when(order >= inserted, order + 1).otherwise(order)


def applied(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Orders from an explicit list of ids a page, of which repeats count once; adds new_order and changed.

    A list that does not have just the ids of its page is refused: the page's rows stay as they are, with accepted false.
    """
    lists = wanted.select("page_id", F.array_distinct("ids").alias("ids"))
    have = rows.groupBy("page_id").agg(F.collect_set("layout_id").alias("have"))
    fits = (F.size("ids") == F.size("have")) & (F.size(F.array_except("ids", "have")) == 0)
    lists = lists.join(have, "page_id").select("page_id", "ids", fits.alias("accepted"))
    both = rows.join(lists, "page_id")
    new = F.when(F.col("accepted"), F.array_position("ids", F.col("layout_id")).cast("int")).otherwise(F.col("reading_order"))
    return both.withColumn("new_order", new).withColumn("changed", F.col("new_order") != F.col("reading_order")).drop("ids")


def natural_key(c: Column) -> Column:
    """A key by which names sort without regard to case and runs of digits by their value, however long: a run's length stands before it."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(p)), "")


def visit_history(visits: DataFrame, user: str, page: str, at: str, most: int = 200) -> DataFrame:
    """(user, history): pages in order of visit without repeats in a row, the last `most` of each user."""
    order = Window.partitionBy(user).orderBy(at)
    rows = visits.withColumn("before", F.lag(page).over(order)).where(F.col("before").isNull() | (F.col("before") != F.col(page)))
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(at)))).where(F.col("back") <= most)
    lists = rows.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(page).alias("page")))).alias("h"))
    return lists.select(user, F.transform("h", lambda x: x["page"]).alias("history"))


def guessed_by_height(middle: Column) -> Column:
    """Aggregate: the order of the first box, in order, that lies below a height, else one more than there are boxes."""
    below = (F.col("y1") + F.col("y2")) / 2 > middle
    return F.coalesce(F.min(F.when(below, F.col("reading_order"))), F.count("*") + 1)


def closed_up(order: Column, removed: int) -> Column:
    """Orders after the box at one place was removed."""
    return F.when(order > removed, order - 1).otherwise(order)


def dragged(ids: Column, moved_id: Column, target: Column, before: bool = False) -> Column:
    """A list of ids with one taken out and put behind, or before, another; null if either is not in it."""
    own = F.array_distinct(ids)
    rest = F.array_remove(own, moved_id)
    at = F.array_position(rest, target).cast("int") - (1 if before else 0)
    new = F.concat(F.slice(rest, F.lit(1), at), F.array(moved_id), F.slice(rest, at + 1, F.greatest(F.lit(0), F.size(rest) - at)))
    return F.when(~F.array_contains(own, moved_id) | ~F.array_contains(own, target), None).when(moved_id == target, own).otherwise(new)


def swapped(ids: Column, moved_id: Column, place: int) -> Column:
    """A list of ids in which one changes places with that at a place, which is kept within the list."""
    own = F.array_distinct(ids)
    to = F.greatest(F.lit(1), F.least(F.lit(place), F.size(own)))
    other = own[to - 1]
    return F.transform(own, lambda x: F.when(x == moved_id, other).when(x == other, moved_id).otherwise(x))
