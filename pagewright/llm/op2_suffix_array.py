"""Suffix-array dedup: bytes that lie in a long string which occurred before are removed.

Suffixes of the compared texts are put in order by two-stage sorting: only
suffixes that are smaller than their successor are sorted directly, all others
are induced by scanning the buckets of first bytes. Common prefixes of
neighbours in that order then tell which windows are equal; every repeat is
read off such a suffix array, first of a batch of texts, then of what the
batches have left under one key. Windows of a key with more rows than an array
is to hold are put in order by Spark's sort of their bytes instead, and
compared with their neighbours in the same way.

Defined results: a null text is empty; a text shorter than the width keeps all
its bytes; rows with a null id keep all their bytes and remove nothing from
others; repeated rows of one id count as one document, so they do not remove
each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import byte_symbols, mix, powers, text_buffer, typed
from .repeats import RANGES, covered, equal_neighbours, found_repeats, judged, key_runs, range_lists, repeat_rows, slices, with_texts

WIDTH, SEED = 100, 16
NAME = "op2_suffix_array_dedup"


def two_stage_order(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of a byte string in order of their first depth bytes; its end sorts first.

    Suffixes smaller than their successor are sorted directly; the others are
    induced: buckets of first bytes are scanned upwards, and the predecessor of
    each suffix met goes, in that order, to the front of its own bucket.
    wanted marks the suffixes to put in order (default all); those that are
    needed to induce them come along.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    t = text.astype(np.int16)
    # smaller[i]: suffix i < suffix i + 1; over a run of one byte the run's end decides
    change = np.flatnonzero(np.append(t[1:], -1) != t)
    end = change[np.searchsorted(change, np.arange(n))]
    smaller = (np.append(t[1:], -1) > t)[end]
    use = np.ones(n, bool)
    if wanted is not None:  # an induced suffix needs its successors up to the first that is sorted directly
        direct_at = np.flatnonzero(smaller)
        upto = np.append(direct_at, n - 1)[np.searchsorted(direct_at, np.arange(n))]
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, np.flatnonzero(wanted), 1)
        np.add.at(mark, upto[wanted] + 1, -1)
        use = np.cumsum(mark[:n]) > 0
    order = np.flatnonzero(smaller & use)
    if len(order):
        padded = np.concatenate((text, np.zeros(depth, np.uint8)))
        keys = np.lib.stride_tricks.sliding_window_view(padded, depth)
        order = order[np.argsort(np.ascontiguousarray(keys[order]).view(f"S{depth}").ravel(), kind="stable")]
    bounds = np.searchsorted(t[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if use[n - 1]:
        waiting[t[n - 1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    out = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        direct = order[bounds[c] : bounds[c + 1]]
        if not len(front) + len(direct):
            continue
        grown = [front]
        while len(front):  # predecessors within this bucket, one step of a run at a time
            p = front[front > 0] - 1
            front = p[(t[p] == c) & ~smaller[p] & use[p]]
            grown.append(front)
        bucket = np.concatenate([*grown, direct])
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[(t[p] > c) & use[p]]
        if len(p):
            lead = t[p]
            rank = np.argsort(lead, kind="stable")
            p, lead = p[rank], lead[rank]
            for part in np.split(p, np.flatnonzero(np.diff(lead)) + 1):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it, at most depth."""
    padded = np.concatenate((text, np.zeros(depth + 8, np.uint8)))
    lcp = np.full(len(order), depth)
    lcp[:1] = 0
    whole = np.lib.stride_tricks.sliding_window_view(padded, depth)
    live = []
    for at in range(1, len(order), 1 << 15):  # neighbours that agree to the full depth are settled first
        rows = np.ascontiguousarray(whole[order[at - 1 : at + (1 << 15)]]).view(f"S{depth}").ravel()
        live.append(at + np.flatnonzero(rows[1:] != rows[:-1]))
    live = np.concatenate(live) if live else np.zeros(0, np.int64)
    lcp[live] = 0
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for at in range(0, depth, 8):
        a, b = (np.ascontiguousarray(view[order[x] + at]).view(">u8").ravel().astype(np.uint64) for x in (live, live - 1))
        x = a ^ b
        same = sum((x < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(8))
        lcp[live] += np.minimum(same, depth - at)
        live = live[x == 0]
    return lcp


def equal_windows(contents: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, offset, run) of the windows that occur in two places or more, from the suffix array of all contents.

    A run of neighbours in the array whose common prefixes have the full width is a set of equal windows.
    """
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    text = np.frombuffer(b"".join(contents), np.uint8)
    start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    room = np.repeat(start + sizes, sizes) - np.arange(len(text))
    order = two_stage_order(text, width, room >= width)
    order = order[room[order] >= width]
    same = common_prefixes(text, order, width) >= width
    run = np.cumsum(~same)
    many = same.copy()
    many[:-1] |= same[1:]
    order, run = order[many], run[many]
    owner = np.searchsorted(start, order, side="right") - 1
    return owner, order - start[owner], run


def window_hashes(part: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window, by which windows are dealt."""
    up, down = powers(len(part) + 1)
    s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte_symbols(part) * up[: len(part)])))
    return mix((s[width:] - s[:-width]) * down[: len(part) - width + 1]).view(np.int64)


def _contents(batches, width: int):
    """The segments to be compared with their bytes; those of hot keys as one row for each window, under the window's own hash."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        buf, offsets = text_buffer(batch.column(1))
        bounds, r = range_lists(batch.column(2))
        doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
        h, hot, n, pos = r["h"], r["hot"].astype(bool), r["n"], r["pos"]
        cold = np.flatnonzero(~hot)
        for at in range(0, len(cold), 1 << 16):
            x = cold[at : at + (1 << 16)]
            begin = offsets[doc[x]] + pos[x]
            yield _part_rows(h[x], None, ids[doc[x]], pos[x], slices(buf, begin, begin + n[x] + width - 1))
        for x in np.flatnonzero(hot).tolist():
            begin = offsets[doc[x]] + pos[x] + np.arange(n[x])
            part = buf[begin[0] : begin[-1] + width]
            yield _part_rows(window_hashes(part, width), slices(buf, begin, begin + width), np.full(n[x], ids[doc[x]]), pos[x] + np.arange(n[x]), None)


def _part_rows(h, window, doc, pos, content) -> pa.RecordBatch:
    none = pa.nulls(len(h), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(h), none if window is None else window, pa.array(doc), pa.array(pos), none if content is None else content], names=["h", "w", "doc_id", "pos", "content"])


def _compared(batches, width: int, size: int):
    """Rows in order of (h, window, doc, pos): one suffix array for a run of whole keys of about size bytes; windows of hot keys are in order already and are compared with their neighbour as they pass."""
    held: list[pa.RecordBatch] = []
    weight, last = 0, (None, 0, 0)

    def flush(rows: pa.Table):
        for lo, hi in key_runs(rows["h"].to_numpy(), pa.compute.binary_length(rows["content"]).to_numpy().astype(np.int64), size):
            part = rows.slice(lo, hi - lo)
            contents = part["content"].to_pylist()
            doc, pos = part["doc_id"].to_numpy(), part["pos"].to_numpy()
            n = np.fromiter(map(len, contents), np.int64, len(contents)) - width + 1
            who, at, m, gone = judged(contents, doc, pos, n, False, lambda c: equal_windows(c, width))
            yield repeat_rows(doc[who[gone]], pos[who[gone]] + at[gone], m[gone])

    for batch in batches:
        single = batch.filter(batch.column(1).is_valid())
        if len(single):
            doc, pos = (single.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            same = equal_neighbours(single.column(1), last[0])
            at = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
            d0, p0 = np.where(at < 0, last[1], doc[at]), np.where(at < 0, last[2], pos[at])
            last = (single.column(1)[-1].as_py(), d0[-1], p0[-1])
            later = (doc != d0) | (pos != p0)
            yield repeat_rows(doc[later], pos[later], np.ones(int(later.sum()), np.int64))
        rows = batch.filter(batch.column(1).is_null())
        if len(rows):
            held.append(rows)
            weight += rows.column(4).nbytes
            if weight > 4 * size:  # the last key may go on
                table = pa.Table.from_batches(held)
                key = table["h"].to_numpy()
                whole = int(np.searchsorted(key, key[-1], side="left"))
                yield from flush(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                weight = sum(b.column(4).nbytes for b in held)
    if held:
        yield from flush(pa.Table.from_batches(held))


def repeated_ranges(docs: DataFrame, width: int, seed: int, size: int) -> DataFrame:
    """(doc_id, pos, n): runs of n windows from pos on that are repeats."""
    found = found_repeats(docs, "byte", width, seed, False, lambda c: equal_windows(c, width), size)
    parts = with_texts(docs, found.where("h is not null"), "inner").mapInArrow(lambda it: _contents(it, width), "h long, w binary, doc_id long, pos long, content binary")
    compared = parts.repartition("h").sortWithinPartitions("h", "w", "doc_id", "pos").mapInArrow(lambda it: _compared(it, width, size), RANGES)
    return found.where("h is null").select("doc_id", "pos", "n").unionByName(compared)


def _result(batches, width: int):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        bounds, r = range_lists(batch.column(2))
        ids = batch.column(0)
        out: dict[str, list] = {x: [] for x in names[1:]}
        for i in range(len(ids)):
            data = buf[offsets[i] : offsets[i + 1]]
            own = slice(bounds[i], bounds[i + 1])
            ranges = bounds[i] < bounds[i + 1]
            gone = covered(r["pos"][own], r["n"][own], len(data), width) if ranges else None
            kept = (data[~gone] if ranges else data).tobytes()
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1)) if ranges else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(out[x], t) for x, t in zip(names[1:], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=list(names))


def suffix_array_dedup(docs: DataFrame, width: int = WIDTH, seed: int = SEED, array_bytes: int = 2 << 20) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes."""
    texts = typed(docs, doc_id="bigint", text="string")
    known = texts.where("doc_id is not null")
    gone = repeated_ranges(known, width, seed, array_bytes)
    none = texts.where("doc_id is null").withColumn("ranges", F.lit(None).cast("array<struct<pos:long,n:long>>"))
    joined = with_texts(known, gone, "left").unionByName(none)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInArrow(lambda it: _result(it, width), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_array_dedup(docs).drop("kept")


QUERIES = {NAME: query}
ORACLES = {
    NAME: """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS i FROM d)),
f AS (SELECT s, min(doc_id * 4294967296 + i) AS first FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN f USING (s) WHERE doc_id * 4294967296 + i > first),
b AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM d)),
c AS (SELECT b.doc_id, b.i, x, coalesce(max(hit.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS UNBOUNDED PRECEDING), -999) >= b.i - 99 AS gone
      FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id AND b.i = hit.i),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, count(*) FILTER (begins) AS p, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(p, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
}
