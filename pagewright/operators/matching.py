"""Scores of detected boxes against true ones: greedy matching and interpolated average precision.

A page's boxes meet in arrays, whose length is bounded by the boxes of a page
and the settings; nothing but the grouping by page is shuffled. The boxes of a
whole Arrow batch are then dealt to classes and settings and matched together,
box by box in order of confidence, under all thresholds at once, without a loop
over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = tuple(x / 100 for x in range(50, 100, 5))
CELLS = 1 << 21  # found x true boxes that are compared at once


def _doubles() -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]


def _padded(column: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    """(4, rows, width) corners of the boxes of some rows, padded with empty boxes."""
    offsets = column.offsets.to_numpy()
    at = offsets[rows][:, None] + np.arange(width)
    inside = at < offsets[rows + 1][:, None]
    boxes = column.values
    fields = [boxes.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")]
    return np.stack([np.where(inside, f[np.minimum(at, max(0, len(f) - 1))], 0.0) if len(f) else np.zeros(at.shape) for f in fields])


def overlaps(found: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """(rows, found, true) intersection over union of padded boxes."""
    a, b = found[:, :, :, None], truth[:, :, None, :]
    wide = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])
    high = np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
    common = np.where((wide > 0) & (high > 0), wide * high, 0.0)
    area = lambda x: np.maximum(0, x[2] - x[0]) * np.maximum(0, x[3] - x[1])
    union = area(a) + area(b) - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def precisions(found: np.ndarray, truth: np.ndarray, n_found: np.ndarray, n_true: np.ndarray) -> np.ndarray:
    """(rows, thresholds) average precision; a found box takes the free true box that it overlaps most, the first on ties."""
    o = overlaps(found, truth)
    rows, p, _ = o.shape
    least = np.array(THRESHOLDS)
    free = np.repeat((np.arange(o.shape[2]) < n_true[:, None])[:, None, :], len(least), axis=1)
    hits = np.zeros((p, rows, len(least)), bool)
    r, t = np.indices((rows, len(least)))
    for k in range(p):
        score = np.where(free & (o[:, k, None, :] >= least[None, :, None]), o[:, k, None, :], -1.0)
        best = score.argmax(axis=2)
        hits[k] = (score[r, t, best] >= 0) & (k < n_found)[:, None]
        free[r, t, best] &= ~hits[k]
    tp = hits.cumsum(axis=0)
    here = (np.arange(1, p + 1)[:, None] <= n_found)[:, :, None]
    precision = np.where(here, tp / np.arange(1, p + 1)[:, None, None], 0.0)
    best = np.maximum.accumulate(precision[::-1], axis=0)[::-1]
    n = np.maximum(1, n_true)[None, :, None]
    steps = 100 * tp // n - 100 * (tp - hits) // n  # recalls, in hundredths, that a hit adds
    return ((best * steps).sum(axis=0) + best[0]) / 101


def _laid(fields: list[np.ndarray], start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(4, rows, width) corners of runs of boxes, padded with empty boxes."""
    at = start[:, None] + np.arange(int(count.max()))
    inside = at < (start + count)[:, None]
    return np.stack([np.where(inside, f[np.minimum(at, len(f) - 1)], 0.0) for f in fields])


def _order(group: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Places of boxes by group, then by two columns; the others settle ties, which are rare."""
    order = np.lexsort((*by[1::-1], group))
    tied = np.ones(max(0, len(order) - 1), bool)
    for x in (group, *by[:2]):
        x = x[order]
        tied &= x[1:] == x[:-1]
    return np.lexsort((*by[::-1], group)) if tied.any() else order


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and length of each run of a sorted array."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return group[start], start, np.diff(np.r_[start, len(group)])


def _coded(columns: list[pa.Array]) -> np.ndarray:
    """One number for each combination of values; null is a value."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        out = np.unique(out * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    return out


def _page_classes(batch: pa.RecordBatch, grid: pa.Table, keys: list[str]) -> list[pa.Array]:
    """(keys, page_id, cls, ap50, ap) of pages with all their boxes: each class of the truth under each setting, and what else was found."""
    page, truth, found = batch.columns
    parts = [(c.flatten(), np.repeat(np.arange(len(batch)), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))) for c in (truth, found)]
    (t, t_row), (f, f_row) = parts
    number = lambda c, null: c.fill_null(null).to_numpy(zero_copy_only=False)
    n_t, n_grid = len(t), grid.num_rows
    names = pa.concat_arrays([t.field("cls"), f.field("cls")]).dictionary_encode()
    # a null class or setting meets none, not even another null one: those that were found have codes of their own
    code = number(names.indices, -1).astype(np.int64)
    most = len(names.dictionary)
    cls_t, cls_f = np.where(code[:n_t] < 0, most, code[:n_t]), np.where(code[n_t:] < 0, most + 1, code[n_t:])
    columns = [pa.concat_arrays([*grid.column(k).chunks, f.field(k).cast(grid.schema.field(k).type)]) for k in keys]
    whole = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    combined = _coded(columns)
    place = np.zeros(int(combined.max(initial=0)) + 1, np.int64)
    place[combined[:n_grid]] = np.arange(n_grid)
    setting = place[combined[n_grid:]] + np.where(whole[n_grid:], 0, n_grid)
    kinds = most + 2
    boxes = lambda x: [number(x.field(c), np.nan) for c in ("x1", "y1", "x2", "y2")]
    low = np.iinfo(np.int64).min
    group, fields = t_row * kinds + cls_t, boxes(t)
    order = _order(group, number(t.field("layout_id"), low), *fields)
    fields_t = [x[order] for x in fields]
    of_t, start_t, n_true = _runs(group[order])
    group, fields = (f_row * (2 * n_grid) + setting) * kinds + cls_f, boxes(f)
    order = _order(group, number(f.field("rank"), -np.inf), number(f.field("pred_id"), low), *fields)
    fields_f = [x[order] for x in fields]
    of_f, start_f, n_found = _runs(group[order])
    row_f, setting_f, kind_f = of_f // (2 * n_grid * kinds), of_f // kinds % (2 * n_grid), of_f % kinds
    wanted = row_f * kinds + kind_f
    at = np.searchsorted(of_t, wanted)
    met = (at < len(of_t)) & (setting_f < n_grid)
    met[met] = of_t[at[met]] == wanted[met]
    ap = np.zeros((2, len(of_t) * n_grid))
    todo = np.flatnonzero(met)
    todo = todo[np.argsort(n_true[at[todo]] * n_found[todo], kind="stable")]
    while len(todo):
        # groups of like size together; at least one
        cells = np.maximum.accumulate(n_true[at[todo]]) * np.maximum.accumulate(n_found[todo]) * np.arange(1, len(todo) + 1)
        now, todo = np.split(todo, [max(1, int(np.searchsorted(cells, CELLS)))])
        own = at[now]
        got = precisions(_laid(fields_f, start_f[now], n_found[now]), _laid(fields_t, start_t[own], n_true[own]), n_found[now], n_true[own])
        ap[:, own * n_grid + setting_f[now]] = got[:, 0], got.mean(axis=1)
    alone = np.flatnonzero(~met)
    none = np.zeros(len(alone))
    setting = np.r_[np.tile(np.arange(n_grid), len(of_t)), setting_f[alone] % max(1, n_grid)]
    # of settings with a null the whole values are the same
    row, kind = np.r_[np.repeat(of_t // kinds, n_grid), row_f[alone]], np.r_[np.repeat(of_t % kinds, n_grid), kind_f[alone]]
    cls = names.dictionary.take(pa.array(kind, mask=kind >= most))
    return [*(pa.concat_arrays(grid.column(k).chunks).take(pa.array(setting)) for k in keys), page.take(pa.array(row)), cls, *(pa.array(np.r_[x, none]) for x in ap)]


#: A grid of settings has at most so many, and so many pages and settings are scored at once.
MOST_SETTINGS, AT_ONCE = 4096, 1 << 16


def _scores(batches: Iterator[pa.RecordBatch], grid: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
    step = max(1, AT_ONCE // max(1, grid.num_rows))
    for batch in batches:
        # without settings nothing was found, nor is anything scored
        for first in range(0, len(batch) if grid.num_rows else 0, step):
            yield pa.RecordBatch.from_arrays(_page_classes(batch.slice(first, step), grid, keys), names=[*keys, "page_id", "cls", "ap50", "ap"])


def class_scores(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_id, cls, ap50, ap): truth: page_id, layout_id, cls and box; found: keys, page_id, pred_id, cls, confidence and box.

    Found boxes are taken by confidence, null last as 0, the earlier id first. A
    class without true boxes scores 0, as does one without found boxes. A page's
    boxes under all settings meet in one row.
    """
    types = dict(found.select(*keys).dtypes)
    # no zero with a sign, as in grouping
    named = [(F.col(k) + F.lit(0).cast(types[k]) if types[k] in ("float", "double") else F.col(k)).alias(k) for k in keys]
    settings = found.select(*named).distinct().limit(MOST_SETTINGS + 1).toArrow()
    if settings.num_rows > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings: score them in parts")
    t = truth.groupBy("page_id").agg(F.collect_list(F.struct("cls", F.col("layout_id").cast("long").alias("layout_id"), *_doubles())).alias("truth"))
    rank = (-F.coalesce("confidence", F.lit(0.0))).cast("double").alias("rank")
    p = found.groupBy("page_id").agg(F.collect_list(F.struct(*named, "cls", rank, F.col("pred_id").cast("long").alias("pred_id"), *_doubles())).alias("found"))
    # by the page alone: rows that lie by page already stay where they are
    both = t.join(p, "page_id", "full")
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"page_id {dict(both.dtypes)['page_id']}", "cls string", "ap50 double", "ap double"])
    return both.select("page_id", "truth", "found").mapInArrow(lambda it: _scores(it, settings, keys), schema)


def page_scores(classes: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the classes of each page; a page without any box scores 1."""
    scored = classes.groupBy(*keys, "page_id").agg(F.avg("ap50").alias("map50"), F.avg("ap").alias("map50_95"))
    return pages.join(scored, [*keys, "page_id"], "left").select(*keys, "page_id", F.coalesce("map50", F.lit(1.0)).alias("map50"), F.coalesce("map50_95", F.lit(1.0)).alias("map50_95"))


#: Pages with more boxes are swept one by one, others are looked at together.
CROWDED = 128


def _hidden_by(box: np.ndarray, others: np.ndarray, most: float) -> np.ndarray:
    """Which of others (4, ..., n) share with box (4, ..., 1) at least `most` of the smaller of the two areas."""
    wide = np.minimum(box[2], others[2]) - np.maximum(box[0], others[0])
    high = np.minimum(box[3], others[3]) - np.maximum(box[1], others[1])
    common = np.where((wide > 0) & (high > 0), wide * high, 0.0)
    area = lambda x: np.maximum(0, x[2] - x[0]) * np.maximum(0, x[3] - x[1])
    least = np.minimum(area(box), area(others))
    # the quotient, as the rule has it, not a product, which rounds otherwise
    return np.where(least > 0, common / np.where(least > 0, least, 1), 0.0) >= most


def kept_together(boxes: np.ndarray, count: np.ndarray, most: float) -> np.ndarray:
    """(rows, n) whether each box is kept; boxes: (4, rows, n), padded, in the order in which they are taken."""
    n = boxes.shape[2]
    alive = np.arange(n) < count[:, None]
    for k in range(n - 1):
        alive[:, k + 1 :] &= ~(alive[:, k : k + 1] & _hidden_by(boxes[:, :, k : k + 1], boxes[:, :, k + 1 :], most))
    return alive


def kept_swept(boxes: np.ndarray, most: float) -> np.ndarray:
    """The same for one page (4, n): a box is compared with those alone that can touch it in a sweep from left to right."""
    by_left = np.argsort(boxes[0], kind="stable")
    swept, rank = boxes[:, by_left], np.empty(len(by_left), np.int64)
    rank[by_left] = np.arange(len(by_left))
    alive = np.ones(len(by_left), bool)
    # widths in classes of powers of two, each swept for itself, so that one wide box does not widen the sweep for all
    width = np.maximum(swept[2] - swept[0], 0)
    kind = np.frexp(width)[1]
    classes = []
    for c in np.unique(kind):
        at = np.flatnonzero(kind == c)
        classes.append((at, swept[0][at], width[at].max()))
    for k in rank.tolist():
        if not alive[k]:
            continue
        for at, left, widest in classes:
            near = at[np.searchsorted(left, swept[0, k] - widest) : np.searchsorted(left, swept[2, k], side="right")]
            near = near[alive[near] & (by_left[near] > by_left[k])]
            if len(near):
                alive[near[_hidden_by(swept[:, k : k + 1], swept[:, near], most)]] = False
    return alive[rank]


def _without(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(batch.num_columns - 1)
        offsets = rows.offsets.to_numpy()
        count = np.diff(offsets)
        keep = np.ones(int(offsets[-1]), bool)
        todo = np.flatnonzero((count > 1) & (count <= CROWDED))
        todo = todo[np.argsort(count[todo], kind="stable")]
        while len(todo):
            cells = np.maximum.accumulate(count[todo]) * np.arange(1, len(todo) + 1)
            now, todo = np.split(todo, [max(1, int(np.searchsorted(cells, CELLS // 8)))])
            n = int(count[now].max())
            alive = kept_together(_padded(rows, now, n), count[now], most)
            at = offsets[now][:, None] + np.arange(n)
            inside = np.arange(n) < count[now][:, None]
            keep[at[inside]] = alive[inside]
        for i in np.flatnonzero(count > CROWDED):
            keep[offsets[i] : offsets[i + 1]] = kept_swept(_padded(rows, np.array([i]), int(count[i]))[:, 0], most)
        first = int(offsets[0])
        upto = np.concatenate(([0], np.cumsum(keep[first:])))
        values = rows.values.slice(first, len(keep) - first).filter(pa.array(keep[first:]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(upto[offsets - first].astype(np.int32)), values)], names=batch.schema.names)


def without_overlaps(found: DataFrame, keys: list[str], most: float = 0.85) -> DataFrame:
    """Boxes of a page kept greedily by confidence, then area: none may cover, or be covered by, most of one kept before."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rank = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), (-area).alias("a"), "pred_id", "cls", "x1", "y1", "x2", "y2")
    pages = found.groupBy(*keys).agg(F.array_sort(F.collect_list(rank)).alias("rows"))
    kept = pages.mapInArrow(lambda it: _without(it, most), pages.schema)
    return kept.select(*keys, F.inline("rows")).drop("c", "a")
