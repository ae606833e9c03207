"""Which windows of a corpus occur more than once: the stages that both substring operators share.

A window is `width` successive symbols (bytes or words) of one document. The
windows are cut into segments that share a minimizer, so equal windows meet
under one key. Keys only choose what is compared with what; whether windows are
equal is always read off the operator's own structure over the symbols
themselves, a suffix array or suffix trees.

Segments whose key occurs twice in a batch of texts are judged in the batch, so
of a passage that is in a third of all documents one copy a batch is left.
What is left is dealt by key; keys that occur once fall away, in a sorted stream
that holds a bounded number of rows. The operators judge the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, block_words, byte_symbols, hash_ranges, segments, spans, staged, text_buffer

#: From distinct contents: (content, offset, run) of the windows that occur in two places or more, equal ones in one run, runs in order.
Equal = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]
SEEDS = "h long, doc_id long, pos long, n long"
FOUND = "h long, doc_id long, pos long, n long, hot boolean"
RANGES = "doc_id long, pos long, n long"
_SEEDS = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int64())])
_FOUND = pa.schema([*_SEEDS, ("hot", pa.bool_())])
_RANGE = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int64())])


def _cut(buf, offsets, unit: str, width: int, k: int) -> Iterator[tuple[dict, np.ndarray]]:
    """Segments of adjacent texts with their rows; positions count from the text's start, begin and end are places in buf."""
    for first, end in spans(offsets):
        lo, hi = int(offsets[first]), int(offsets[end])
        data, bounds = buf[lo:hi], offsets[first : end + 1] - lo
        if unit == "byte":
            start, stop = bounds[:-1], bounds[1:]
        else:
            ws, we, row = block_words(data, bounds)
            words = hash_ranges(data, ws, we)
            start = np.searchsorted(row, np.arange(end - first), side="left")
            stop = np.searchsorted(row, np.arange(end - first), side="right")
        size = len(data) if unit == "byte" else len(words)
        for at in range(0, max(1, size), BLOCK) if end - first == 1 else (0,):  # a very long text in tiles that overlap
            to = min(size, at + BLOCK + width - 1) if end - first == 1 else size
            sym = byte_symbols(data[at:to]) if unit == "byte" else words[at:to]
            got = segments(sym, np.clip(start - at, 0, to - at), np.clip(stop - at, 0, to - at), width, k)
            begin, last = got["start"] + at, got["start"] + at + got["n"] + width - 2
            rows = np.searchsorted(start, begin, side="right") - 1
            got["start"] = begin - start[rows]
            got["begin"], got["end"] = (lo + begin, lo + last + 1) if unit == "byte" else (lo + ws[begin], lo + we[last])
            yield got, rows + first


def judged(contents: list[bytes], doc: np.ndarray, pos: np.ndarray, n: np.ndarray, across: bool, equal: Equal):
    """Runs (who, at, n, gone) that make up all windows of the contents; gone: an equal window comes earlier.

    Equal contents are one string of the structure with a list of places. Of
    the windows in one run of the structure the first place stays; across: all
    places in the first document stay.
    """
    order = np.lexsort((pos, doc))
    place: dict[bytes, int] = {}
    which = np.fromiter((place.setdefault(contents[i], len(place)) for i in order.tolist()), np.int64, len(order))
    lead = order[np.unique(which, return_index=True)[1]]
    size = n[lead]
    base = np.concatenate(([0], np.cumsum(size)))
    flags = np.zeros(int(base[-1]), bool)
    c, off, run = equal(list(place))
    if len(c):
        rank = np.unique(doc, return_inverse=True)[1][lead]
        when = (rank[c] << 32) | (pos[lead][c] + off)
        starts = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
        first = np.repeat(np.minimum.reduceat(when, starts), np.diff(np.append(starts, len(run))))
        flags[base[c] + off] = (when >> 32 > first >> 32) if across else when > first
    # runs of equal flags within a content
    edge = np.zeros(len(flags), bool)
    edge[base[:-1]] = True
    edge[1:] |= flags[1:] != flags[:-1]
    begin = np.flatnonzero(edge)
    length = np.diff(np.append(begin, len(flags)))
    whose = np.searchsorted(base, begin, side="right") - 1
    # every other place of a content comes after its first one; across, those in the same document stay or go with it
    leads = np.zeros(len(contents), bool)
    leads[lead] = True
    place_of = np.empty(len(contents), np.int64)
    place_of[order] = which
    like = leads | (doc == doc[lead][place_of]) if across else leads
    rest, like = np.flatnonzero(~like), np.flatnonzero(like)
    runs = np.bincount(whose, minlength=len(lead))
    many = runs[place_of[like]]
    pick = np.arange(int(many.sum())) + np.repeat((np.cumsum(runs) - runs)[place_of[like]] - (np.cumsum(many) - many), many)
    return (
        np.concatenate((np.repeat(like, many), rest)),
        np.concatenate((begin[pick] - base[whose[pick]], np.zeros(len(rest), np.int64))),
        np.concatenate((length[pick], n[rest])),
        np.concatenate((flags[begin[pick]], np.ones(len(rest), bool))),
    )


def key_runs(key: np.ndarray, weight: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of whole keys, rows in order of key, of about size in weight."""
    if not len(key):
        return []
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    full = (np.cumsum(weight) - weight)[starts] // size
    cuts = starts[np.flatnonzero(np.diff(full, prepend=-1))]
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True))


def _seeds(batches, unit: str, width: int, k: int, across: bool, equal: Equal, size: int):
    """What is left of a batch's segments under their keys, and under no key the runs that the batch has shown to be repeats."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        buf, offsets = text_buffer(batch.column(1))
        parts = [(g, ids[r]) for g, r in _cut(buf, offsets, unit, width, k) if len(r)]
        if not parts:
            continue
        key, pos, n, begin, end = (np.concatenate([g[x] for g, _ in parts]) for x in ("key", "start", "n", "begin", "end"))
        doc = np.concatenate([d for _, d in parts])
        del parts
        order = np.lexsort((pos, doc, key))
        key, doc, pos, n, begin, end = (x[order] for x in (key, doc, pos, n.astype(np.int64), begin, end))
        some = _shared_keys(key, doc, across)
        yield _seed_rows(key[~some], doc[~some], pos[~some], n[~some], np.zeros(int((~some).sum()), bool))
        key, doc, pos, n, begin, end = (x[some] for x in (key, doc, pos, n, begin, end))
        for lo, hi in key_runs(key, end - begin, size):
            contents = [buf[a:b].tobytes() for a, b in zip(begin[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
            who, at, m, gone = judged(contents, doc[lo:hi], pos[lo:hi], n[lo:hi], across, equal)
            yield _seed_rows(key[lo:hi][who], doc[lo:hi][who], pos[lo:hi][who] + at, m, gone)


def _seed_rows(key, doc, pos, n, gone) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64), mask=gone), pa.array(doc), pa.array(pos), pa.array(n)], schema=_SEEDS)


def _shared_keys(key: np.ndarray, doc: np.ndarray, across: bool) -> np.ndarray:
    """Rows, in order of key, whose key has another row; across: one of another document."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    some = np.maximum.reduceat(doc, starts) != np.minimum.reduceat(doc, starts) if across else sizes > 1
    return np.repeat(some, sizes)


def _shared(batches, across: bool, hot: int):
    """Over rows in order of (h, doc, pos): those of keys that occur twice, and those that are settled; a key of more than `hot` rows is passed on as it comes."""
    kept = None
    passing = None  # the key whose rows are more than can be held

    def rows(cols, is_hot):
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(is_hot)], schema=_FOUND)

    for batch in _and_end(batches):
        if batch is not None:
            done = batch.column(0).is_null()
            settled = batch.filter(done)
            if len(settled):
                yield pa.RecordBatch.from_arrays([*settled.columns, pa.array(np.zeros(len(settled), bool))], schema=_FOUND)
            new = [c.to_numpy(zero_copy_only=False) for c in batch.filter(pa.compute.invert(done)).columns]
            kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
        if kept is None or not len(kept[0]):
            continue
        if passing is not None:  # its further rows stand in front
            n = int(np.searchsorted(kept[0], passing, side="right"))
            if n:
                yield rows([x[:n] for x in kept], np.ones(n, bool))
            kept = [x[n:] for x in kept]
            if not len(kept[0]):
                continue
            passing = None
        whole = len(kept[0]) if batch is None else int(np.searchsorted(kept[0], kept[0][-1], side="left"))
        if whole:
            now, kept = [x[:whole] for x in kept], [x[whole:] for x in kept]
            some = _shared_keys(now[0], now[1], across)
            now = [x[some] for x in now]
            starts = np.flatnonzero(np.concatenate(([True], now[0][1:] != now[0][:-1]))) if len(now[0]) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(now[0])))
            yield rows(now, np.repeat(sizes > hot, sizes))
        if len(kept[0]) > hot:
            passing = kept[0][0]
            yield rows(kept, np.ones(len(kept[0]), bool))
            kept = [x[:0] for x in kept]


def _and_end(batches):
    yield from batches
    yield None


def repeated(docs: DataFrame, unit: str, width: int, k: int, across: bool, equal: Equal, size: int, hot: int = 4096) -> DataFrame:
    """docs: doc_id long, never null, and text. Rows (h, doc_id, pos, n, hot): n windows from pos on that are repeats (h null), or that are to be compared under h.

    across: only an occurrence in a document of smaller id counts, else also an
    earlier one in the same document. hot marks keys with more than `hot` rows,
    which no task is to hold at once.
    """
    dealt = docs.select("doc_id", "text").mapInArrow(lambda it: _seeds(it, unit, width, k, across, equal, size), SEEDS)
    dealt = dealt.repartition(F.coalesce("h", "doc_id")).sortWithinPartitions("h", "doc_id", "pos")
    return dealt.mapInArrow(lambda it: _shared(it, across, hot), FOUND)


def found_repeats(docs: DataFrame, unit: str, *args, **kwargs) -> DataFrame:
    """The rows of `repeated`, written, as they are read twice."""
    return staged(repeated(docs, unit, *args, **kwargs), f"repeats-{unit}")


def with_texts(docs: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """docs, none with a null id, with their ranges as an array; the texts are dealt by doc_id, once for all uses in a plan, and not sorted."""
    lists = ranges.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in ranges.columns if c != "doc_id"])).alias("ranges"))
    return docs.join(lists.hint("shuffle_hash"), "doc_id", how)


def range_lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, fields) of an array of structs; a null list is empty."""
    bounds = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat = column.flatten()
    return bounds, {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}


def slices(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """buf[begin:end] of each row, as binary."""
    size = end - begin
    off = np.concatenate(([0], np.cumsum(size)))
    data = buf[np.arange(int(off[-1])) + np.repeat(begin - off[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


def equal_neighbours(column: pa.Array, last) -> np.ndarray:
    """Whether each value equals the one before it; last: the value before the first, or None."""
    same = np.zeros(len(column), bool)
    same[0] = last is not None and column[0].as_py() == last
    if len(column) > 1:
        same[1:] = pa.compute.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return same


def repeat_rows(doc, pos, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.array(n)], schema=_RANGE)


def covered(pos: np.ndarray, n: np.ndarray, size: int, width: int) -> np.ndarray:
    """Which of size symbols lie in a window that the ranges (pos, n) start."""
    mark = np.bincount(np.minimum(pos, size), minlength=size + 1) - np.bincount(np.minimum(pos + n + width - 1, size), minlength=size + 1)
    return np.cumsum(mark[:size]) > 0
