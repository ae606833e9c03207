"""Histories of visited pages, with going back and forward: a fold over each user's steps, in a batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST = 200
SCHEMA = "user long, history array<long>, place int"
VISIT, BACK, FORWARD = "visit", "back", "forward"


def stepped(history: list[int], place: int, kind: str, page: int | None, most: int = MOST) -> tuple[list[int], int]:
    """The history and the place in it after one step; place is -1 in an empty one.

    A visit of another page than that at the place drops what lies ahead of it and
    is put there; the oldest pages go when there are more than `most`. Going back
    and forward moves the place within the history; a visit of no page does nothing.
    """
    if kind == BACK:
        return history, max(place - 1, min(place, 0))
    if kind == FORWARD:
        return history, min(place + 1, len(history) - 1)
    if not page or page <= 0 or place >= 0 and history[place] == page:
        return history, place
    history = [*history[: place + 1], page][-most:]
    return history, len(history) - 1


def _folded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of users one after another, each user's in order; only the state of one user is held."""
    users: list[int] = []
    out: list[tuple[list[int], int]] = []
    now: tuple[list[int], int] = ([], -1)

    def ended() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array([h for h, _ in out], pa.list_(pa.int64())), pa.array([p for _, p in out], pa.int32())], names=["user", "history", "place"])
        users.clear()
        out.clear()
        return rows

    last = None
    for batch in batches:
        for user, kind, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if user != last:
                if last is not None:
                    users.append(last)
                    out.append(now)
                last, now = user, ([], -1)
            now = stepped(*now, kind, page, most)
        if len(users) > 4096:
            yield ended()
    if last is not None:
        users.append(last)
        out.append(now)
    if users:
        yield ended()


def histories(steps: DataFrame, most: int = MOST) -> DataFrame:
    """(user, history, place) from steps: user, at, kind (visit, back or forward) and page. Steps without a user are left out."""
    rows = steps.where("user IS NOT NULL").select(F.col("user").cast("long"), "kind", F.col("page").cast("long"), "at")
    dealt = rows.repartition("user").sortWithinPartitions("user", "at")
    return dealt.select("user", "kind", "page").mapInArrow(lambda it: _folded(it, most), SCHEMA)


def history_stream(steps: DataFrame, most: int = MOST) -> DataFrame:
    """The same of a stream of steps: each batch gives the new state of the users that it has steps of."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history, place = state.get if state.exists else ((), -1)
        now = (list(history), int(place))
        for part in [pd.concat(list(parts)).sort_values("at", kind="stable")]:
            for kind, page in zip(part["kind"], part["page"]):
                now = stepped(*now, kind, None if pd.isna(page) else int(page), most)
        state.update(now)
        yield pd.DataFrame({"user": [key[0]], "history": [now[0]], "place": [now[1]]})

    rows = steps.where("user IS NOT NULL").select(F.col("user").cast("long"), "at", "kind", F.col("page").cast("long"))
    return rows.groupBy("user").applyInPandasWithState(update, SCHEMA, "history array<long>, place int", "update", GroupStateTimeout.NoTimeout)


def neighbour(history: Column, place: Column, step: int) -> Column:
    """The page one step back (-1) or forward (1) from the place; null at the ends."""
    at = place + step
    return F.when((place >= 0) & (at >= 0) & (at < F.size(history)), F.get(history, at))


def allowed_only(history: Column, place: Column, allowed: Column) -> Column:
    """(history, place) with the allowed pages alone; the place is that of the last one kept at or before it, else the first."""
    kept = F.filter(history, lambda p: F.array_contains(allowed, p))
    upto = F.size(F.filter(F.slice(history, F.lit(1), F.greatest(place, F.lit(-1)) + 1), lambda p: F.array_contains(allowed, p)))
    return F.struct(kept.alias("history"), F.when(F.size(kept) == 0, F.lit(-1)).otherwise(F.greatest(upto - 1, F.lit(0))).alias("place"))
