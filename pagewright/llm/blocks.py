"""Arrow and numpy tools shared by the operators: text buffers, rolling hashes, segments.

Everything here works on bounded blocks of a record batch, so the memory of a
Python worker does not depend on the length of a document or of a partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BLOCK = 1 << 20  # bytes that are hashed at once
#: A table of a number or two a row is broadcast up to this many rows (some 64 MB); above, it is joined by a shuffle.
BROADCAST_ROWS = 1 << 20
_POS = U((1 << 24) - 1)
_ROOT = U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK + 4096)
        for name, root in (("up", int(_ROOT)), ("down", pow(int(_ROOT), -1, 2**64))):
            p = np.full(n, root, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def spans(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs [first, end) of rows with at most size bytes, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, end
        first = end


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    inside = ~WHITE[buf]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def block_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and rows of adjacent texts; a word never spans two of them."""
    inside = ~WHITE[buf]
    prev = np.zeros(len(buf), bool)
    prev[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(buf)]
    prev[cut] = False
    start = np.flatnonzero(inside & ~prev)
    nxt = np.zeros(len(buf), bool)
    nxt[:-1] = inside[1:]
    nxt[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~nxt) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they lie."""
    n = len(buf)
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(start, base + BLOCK, side="left")))
        stop = int(end[lo:hi].max())
        if stop - base > 4 * BLOCK and hi - lo > 1:
            hi = lo + 1
            stop = int(end[lo])
        up, down = powers(stop - base + 1)
        s = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_BYTE[buf[base:stop]] * up[: stop - base], out=s[1:])
        a, b = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((s[b] - s[a]) * down[a] + (b - a).astype(np.uint64) * _ROOT)
        lo = hi
    return out


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width successive values, by doubling."""
    m, have = v, 1
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments(sym: np.ndarray, row_start: np.ndarray, row_end: np.ndarray, width: int, k: int) -> dict[str, np.ndarray]:
    """Cut the windows of width symbols into runs that share one minimizer.

    The minimizer is the leftmost k-gram of least hash within a window, so equal
    windows have equal minimizers wherever they occur, and every window lies in
    exactly one run. Returns arrays: start (first window), n (windows), key (the
    minimizer's hash), content (hash of all symbols of the run).
    """
    empty = {x: np.zeros(0, np.int64 if x in ("start", "n") else np.uint64) for x in ("start", "n", "key", "content")}
    n = len(sym)
    if n < width:
        return empty
    up, down = powers(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(sym * up[:n], out=s[1:])
    gram = mix((s[k:] - s[:-k]) * down[: n - k + 1])
    least = sliding_min((gram & ~_POS) | np.arange(len(gram), dtype=np.uint64), width - k + 1)
    pos = (least & _POS).astype(np.int64)
    mark = np.zeros(n + 1, np.int32)
    fits = row_end - row_start >= width
    np.add.at(mark, row_start[fits], 1)
    np.add.at(mark, row_end[fits] - width + 1, -1)
    good = np.cumsum(mark)[: n - width + 1] > 0
    # adjacent rows are kept apart by the width - 1 windows that would cross
    first = good.copy()
    first[1:] &= (pos[1:] != pos[:-1]) | ~good[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return empty
    stop = good.copy()
    stop[:-1] &= first[1:] | ~good[1:]
    last = np.flatnonzero(stop)
    size = last + width - start
    content = mix((s[last + width] - s[start]) * down[start] + size.astype(np.uint64) * _ROOT)
    return {"start": start, "n": last - start + 1, "key": gram[pos[start]], "content": content}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared checkpoint folder and read it back: lineage ends here.

    The folder is spark.checkpoint.dir of the session, which all executors
    share. What is written lives as long as the session's driver, or until it
    is given to `discarded`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    del df
    out = spark.read.parquet(path)
    jvm, folder = _folder(spark, path)
    if jvm is not None:
        folder[0].deleteOnExit(folder[1])
        # shuffle files of the finished job go when the JVM notices that nobody holds them, which is so once another plan is at hand
        jvm.System.gc()
    return out


def discarded(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing will read again."""
    files = df.inputFiles()
    jvm, folder = _folder(df.sparkSession, files[0].rsplit("/", 1)[0] if files else "")
    if files and jvm is not None:
        folder[0].delete(folder[1], True)


def _folder(spark: SparkSession, path: str):
    """(JVM, (file system, path)); without a JVM at hand, as in a remote session, (None, None)."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None or not path:
        return None, None
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, (at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at)


def typed(df: DataFrame, **types: str) -> DataFrame:
    """The named columns; cast only where needed, as a cast in one use of a scan keeps Spark from reusing its exchange."""
    have = dict(df.dtypes)
    return df.select(*[df[c] if have[c] == t else df[c].cast(t).alias(c) for c, t in types.items()])


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to have at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def counted_join(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the other columns of table, left where table lacks the key; count: how many of the rows have each key.

    Keys with more than a BROADCAST_ROWS-th of all rows are fewer than
    BROADCAST_ROWS, so they are broadcast; only keys of few rows are dealt, and
    no key is hot.
    """
    least = (table.agg(F.sum(count)).first()[0] or 0) // BROADCAST_ROWS
    often, seldom = table.where(F.col(count) > least).drop(count), table.where(F.col(count) <= least).drop(count)
    if not least:  # so few rows in all that each key is among them
        return rows.join(F.broadcast(often), key, "left")
    apart = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(apart.join(seldom, key, "left"))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, as in tests, may be without it and then uses a folder below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/staging").rstrip("/")
