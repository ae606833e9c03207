"""Packing along a space-filling curve.

Each document's token counts are hashed to a short vector and projected to
three dimensions; the Hilbert key of the point orders the documents, so
neighbours along the curve share vocabulary. Documents are range-sorted by key
and laid end to end; every `size` tokens of a range are one sequence, so only
the last sequence of a range is padded.

Defined results: a null or empty text is the end token alone; rows with null
or repeated ids are packed row by row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import staged, typed
from .encoding import default_vocabulary, encoded

NAME = "op8_hilbert_packing"
SIZE, END, DIMS, BITS, HASHED = 1024, 0, 3, 10, 256
RANGE = 1 << 22  # tokens of a range: thousands of sequences, of which one is padded
_PROJECT = np.random.default_rng(8).standard_normal((HASHED, DIMS))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (rows) with so many bits a dimension.

    The bits of each point are turned from axes to the curve's transposed form,
    by undoing the exchanges and inversions of each level, and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            flip = (x[i] & level) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        t = np.where(x[n - 1] & level, t ^ (level - 1), t)
        level >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed count vectors: projected, scaled to unit length and cut to a grid."""
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    point = vectors @ _PROJECT / np.where(norm > 0, norm, 1)
    grid = np.clip((point + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_keys(grid, BITS)


def _coded(batches, path: str, end: int):
    slot = np.random.default_rng(9).integers(0, HASHED, 1 << 18)
    for batch in batches:
        rows, n, vectors = [], [], np.zeros((len(batch), HASHED))
        for i, ids in enumerate(encoded(batch.column(1), path)):
            vectors[i] = np.bincount(slot[ids & 0x3FFFF], minlength=HASHED)
            n.append(len(ids) + 1)
            ids = np.append(ids, np.uint32(end))
            rows.append((ids.astype(np.uint16) if ids.max() < 65536 else ids).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve_keys(vectors)), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "key", "n", "ids"])


def _packed(batches, size: int):
    """Rows of one range in order: the cut pieces. A sequence's id is its range's number and its place in it."""
    at = TaskContext.get().partitionId() << 32
    used = 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, n, coded in zip(batch.column(0), batch.column(1), batch.column(2)):
            coded = coded.as_py()
            ids = np.frombuffer(coded, np.uint16 if len(coded) == 2 * n.as_py() else np.uint32).astype("<u4")
            doc, start = doc.as_py(), 0
            while start < len(ids):
                n = min(size - used, len(ids) - start)
                part = ids[start : start + n].tobytes()
                for column, value in zip(out, (doc, start, n, zlib.crc32(part), len(ids), at, used, part), strict=True):
                    column.append(value)
                start += n
                used += n
                if used == size:
                    at, used = at + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == "ids" else pa.int64()) for c, x in zip(names, out)], names=names)


def pack(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids as little-endian uint32."""
    path = vocabulary or default_vocabulary()
    # written once, as the range bounds are found by a sample of the keys and encoding is the cost
    coded = typed(docs, doc_id="bigint", text="string").mapInArrow(lambda it: _coded(it, path, end), "doc_id long, key long, n long, ids binary")
    coded = staged(coded, "coded").withColumn("tie", F.xxhash64("ids"))
    ranges = -(-(coded.agg(F.sum("n")).first()[0] or 1) // RANGE)
    dealt = coded.repartitionByRange(ranges, "key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return dealt.select("doc_id", "n", "ids").mapInArrow(lambda it: _packed(it, size), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("ids")


QUERIES = {NAME: query}
