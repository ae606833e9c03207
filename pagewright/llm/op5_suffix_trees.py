"""Substring dedup: words that lie in a long passage which a document of smaller id also has are removed.

Suffixes that may begin a repeat are dealt by prefixes of variable length: the
suffixes that begin with each word are counted, and a prefix that too many
begin with is taken one word longer, until each has as many as fit in memory;
rare prefixes share a group. The suffixes of a prefix are one subtree of the
suffix tree, read off sorted suffixes and the common prefixes of neighbours; the
nodes of depth `width` are the repeats, and the smallest document below such a
node decides which of its leaves are covered. What repeats within one batch of texts is
found by the same trees, built in memory, before anything is dealt.

Defined results: a null text has no words; a text of fewer words than the
width keeps all; rows with a null id keep all their words and remove nothing
from others; repeated rows of one id count as one document; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import BLOCK, U, block_words, hash_ranges, mix, spans, staged, text_buffer, typed, words_of
from .repeats import RANGES, covered, found_repeats, range_lists, repeat_rows, slices, with_texts

WIDTH, SEED = 13, 5
GROUP = 1 << 18  # suffixes of a prefix group, some 20 MB
NAME = "op5_suffix_tree_dedup"


def prefix_groups(words: np.ndarray, start: np.ndarray, width: int, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """Split suffixes, which begin at start, by prefixes that grow until a group has at most `most` suffixes.

    Yields (suffixes, length of their common prefix). A group whose prefix
    reaches the width needs no further split: its suffixes are one node.
    """
    todo = [(start, 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= most or depth >= width:
            yield group, depth
            continue
        head = words[group + depth]
        order = np.argsort(head, kind="stable")
        cuts = np.flatnonzero(np.diff(head[order])) + 1
        todo.extend((x, depth + 1) for x in np.split(group[order], cuts))


def subtree(words: np.ndarray, group: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of one prefix group down to depth width: its leaves in order, and the common prefix of each with the one before."""
    keys = np.stack([words[group + j] for j in range(depth, width)]) if depth < width else np.zeros((1, len(group)), np.int64)
    leaves = np.lexsort(keys[::-1])
    lcp = np.full(len(group), depth)
    agree = np.ones(len(group) - 1, bool)
    for row in keys[:, leaves] if depth < width else ():
        agree &= row[1:] == row[:-1]
        lcp[1:] += agree
    lcp[:1] = 0
    return group[leaves], lcp


def deep_nodes(leaves: np.ndarray, lcp: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, node) of the topmost internal nodes of depth width or more: runs of leaves whose common prefixes reach it."""
    deep = lcp >= width
    inner = deep.copy()
    inner[:-1] |= deep[1:]
    return leaves[inner], np.cumsum(~deep)[inner]


def equal_windows(contents: list[bytes], width: int, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, offset, node) of the windows below the deep nodes of the subtrees of all contents."""
    ids: dict[bytes, int] = {}
    split = [c.split() for c in contents]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter((ids.setdefault(w, len(ids)) for s in split for w in s), np.int64, int(sizes.sum()))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(split)), sizes)
    at = np.arange(len(words))
    start = at[begin[owner + 1] - at >= width]
    found, nodes, count = [start[:0]], [start[:0]], 0
    for group, depth in prefix_groups(words, start, width, most):
        if len(group) > 1:
            leaf, node = deep_nodes(*subtree(words, group, depth, width), width)
            found.append(leaf)
            nodes.append(node + count)
            count += len(group) + 1
    leaf, node = np.concatenate(found), np.concatenate(nodes)
    return owner[leaf], leaf - begin[owner[leaf]], node


def _stretches(batches, width: int):
    """What is to be compared of each text, its words joined by one space: adjacent segments as one stretch."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        buf, offsets = text_buffer(batch.column(1))
        bounds, r = range_lists(batch.column(2))
        out: list[list] = [[], [], []]
        for i in range(len(ids)):
            pos, n = r["pos"][bounds[i] : bounds[i + 1]], r["n"][bounds[i] : bounds[i + 1]]
            words = buf[offsets[i] : offsets[i + 1]].tobytes().split()
            start = np.bincount(pos, minlength=len(words) + 1) - np.bincount(pos + n, minlength=len(words) + 1)
            edge = np.diff((np.cumsum(start) > 0).view(np.int8), prepend=0)
            for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                for column, value in zip(out, (ids[i], x, b" ".join(words[x : y + width - 1])), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "pos", "content"])


def _labelled(batch: pa.RecordBatch, width: int, crowded: list[np.ndarray]):
    """Of the suffixes of each block of stretches: texts, word places, rows, first words, the label of each one's prefix, and whether its length is the last one counted.

    A prefix that is in crowded is taken one word longer.
    """
    buf, offsets = text_buffer(batch.column(2))
    for first, end in spans(offsets, BLOCK):
        lo = int(offsets[first])
        data, bounds = buf[lo : int(offsets[end])], offsets[first : end + 1] - lo
        ws, we, row = block_words(data, bounds)
        words = hash_ranges(data, ws, we)
        last = np.searchsorted(row, np.arange(end - first), side="right")
        start = np.flatnonzero(np.arange(len(row)) <= last[row] - width)
        label = mix(words[start])
        open_ = np.arange(len(start))
        for depth, full in enumerate(crowded, 1):
            open_ = open_[np.isin(label[open_], full)]
            label[open_] = mix(label[open_] * U(0x9FB21C651E98DF25) + words[start[open_] + depth])
        begin = np.searchsorted(row, np.arange(end - first), side="left")
        yield data, ws, we, row + first, start, start - begin[row[start]], label, open_


def _counted(batches, width: int, crowded: list[np.ndarray]):
    for batch in batches:
        for *_, label, open_ in _labelled(batch, width, crowded):
            found, n = np.unique(label[open_], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["label", "n"])


def prefixes(stretches: DataFrame, width: int, most: int) -> list[np.ndarray]:
    """For each length from one word on, the labels of the prefixes that more suffixes begin with than a group is to have.

    A group has at most `most` suffixes, or a millionth of all if that is more,
    so at most a million labels of each length come to the driver.
    """
    crowded: list[np.ndarray] = []
    while len(crowded) < width - 1:
        counts = stretches.mapInArrow(lambda it: _counted(it, width, crowded), "label long, n long").groupBy("label").agg(F.sum("n").alias("n"))
        if not crowded:
            counts = staged(counts, "prefixes")
            most = max(most, (counts.agg(F.sum("n")).first()[0] or 0) >> 20)
        full = np.array([r.label for r in counts.where(F.col("n") > most).select("label").collect()], np.int64)
        if not len(full):
            break
        crowded = [*crowded, full.view(np.uint64)]
    return crowded


def _suffixes(batches, width: int, crowded: list[np.ndarray], groups: int):
    """Suffixes to the depth of width, as one compressed block for each group of prefixes and batch."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for data, ws, we, row, start, off, label, _ in _labelled(batch, width, crowded):
            group = (label % U(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            bounds = np.flatnonzero(np.diff(group[order], prepend=-1))
            out: list[list] = [[], [], []]
            for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)]):
                x = order[lo:hi]
                begin, end = ws[start[x]], we[start[x] + width - 1]
                suffixes = slices(data, begin, end)
                raw = (end - begin).astype("<u4").tobytes() + doc[row[start[x]]].astype("<i8").tobytes() + (pos[row[start[x]]] + off[x]).astype("<i8").tobytes() + suffixes.buffers()[2].to_pybytes()
                for column, value in zip(out, (group[x[0]], len(x), pack(raw)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bin", "n", "block"])


def _unpacked(n: int, raw: bytes) -> pa.RecordBatch:
    size = np.frombuffer(raw, "<u4", n).astype(np.int32)
    off = np.concatenate((np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)))
    suffixes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(raw[20 * n :])])
    return pa.RecordBatch.from_arrays([suffixes, pa.array(np.frombuffer(raw, "<i8", n, 4 * n)), pa.array(np.frombuffer(raw, "<i8", n, 12 * n))], names=["suffix", "doc_id", "pos"])


def _grown(rows: pa.Table, width: int, most: int) -> np.ndarray:
    """Which suffixes of a group are leaves below a deep node of its subtrees and not of that node's smallest document."""
    buf, offsets = text_buffer(rows["suffix"])
    ws, we, _ = block_words(buf[: int(offsets[-1])], offsets)
    words = slices(buf, ws, we).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
    doc = rows["doc_id"].to_numpy()
    gone = np.zeros(len(doc), bool)
    for group, depth in prefix_groups(words, np.arange(len(doc)) * width, width, most):
        leaf, node = deep_nodes(*subtree(words, group, depth, width), width)
        leaf //= width
        if len(leaf):
            starts = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
            least = np.repeat(np.minimum.reduceat(doc[leaf], starts), np.diff(np.append(starts, len(node))))
            gone[leaf[doc[leaf] != least]] = True
    return gone


def _subtrees(batches, width: int, most: int):
    """Blocks in order of their groups: leaves that do not belong to the smallest document below their node.

    What is found to be a repeat stays one whatever else comes, so a group that
    is larger than memory allows, as all its suffixes are equal, is thinned out
    on the way.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    now, held, limit = None, [], 0

    def thinned():
        rows = pa.Table.from_batches(held).combine_chunks()
        gone = _grown(rows, width, most)
        found = rows.filter(pa.array(gone))
        return rows.filter(pa.array(~gone)).combine_chunks().to_batches(), repeat_rows(found["doc_id"].to_numpy(), found["pos"].to_numpy(), np.ones(len(found), np.int64))

    for batch in batches:
        for group, n, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != now and held:
                yield thinned()[1]
                held = []
            if group != now:
                now, limit = group, 4 * most
            held.append(_unpacked(n, unpack(block)))
            if sum(map(len, held)) > limit:
                held, found = thinned()
                limit = 4 * most + sum(map(len, held))
                yield found
    if held:
        yield thinned()[1]


def repeated_ranges(docs: DataFrame, width: int, seed: int, size: int, most: int) -> DataFrame:
    """(doc_id, pos, n): runs of n windows from pos on that also start in a document of smaller id."""
    found = found_repeats(docs, "word", width, seed, True, lambda c: equal_windows(c, width), size)
    open_ = found.where("h is not null")
    stretches = staged(with_texts(docs.select("doc_id", "text"), open_.select("doc_id", "pos", "n"), "inner").mapInArrow(lambda it: _stretches(it, width), "doc_id long, pos long, content binary"), "stretches")
    groups = -(-2 * (open_.agg(F.sum("n")).first()[0] or 1) // most)  # half full on average, so that prefixes of up to `most` suffixes fit in
    crowded = prefixes(stretches, width, most)
    blocks = stretches.mapInArrow(lambda it: _suffixes(it, width, crowded, groups), "bin long, n long, block binary")
    leaves = blocks.repartition("bin").sortWithinPartitions("bin").mapInArrow(lambda it: _subtrees(it, width, most), RANGES)
    return staged(found.where("h is null").select("doc_id", "pos", "n").unionByName(leaves), "ranges")


def _result(batches, width: int, names: list[str]):
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        bounds, r = range_lists(batch.column(batch.num_columns - 1))
        out: dict[str, list] = {x: [] for x in ("n_words", "n_removed", "kept_sha256", "kept", "cut")}
        for i in range(len(batch)):
            text = buf[offsets[i] : offsets[i + 1]]
            words = text.tobytes().split()
            left, cut = words, text.tobytes()
            if bounds[i] < bounds[i + 1]:
                own = slice(bounds[i], bounds[i + 1])
                gone = covered(r["pos"][own], r["n"][own], len(words), width)
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                start, _ = words_of(text)
                # a removed word goes with the white space behind it
                mark = np.zeros(len(text) + 1, np.int32)
                mark[start[gone]] += 1
                mark[np.append(start, len(text))[1:][gone]] -= 1
                cut = text[np.cumsum(mark[:-1]) == 0].tobytes()
            kept = b" ".join(left)
            for name, value in zip(out, (len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept, cut), strict=True):
                out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        measured = {x: pa.array(v, k) for (x, v), k in zip(out.items(), kinds, strict=True)} | {"doc_id": batch.column(0)}
        yield pa.RecordBatch.from_arrays([measured[x] if x in measured else batch.column(batch.schema.get_field_index(x)) for x in names], names=names)


def _dedup(texts: DataFrame, width: int, seed: int, size: int, most: int, schema: StructType) -> DataFrame:
    known = texts.where("doc_id is not null")
    gone = repeated_ranges(known, width, seed, size, most)
    none = texts.where("doc_id is null").withColumn("ranges", F.lit(None).cast("array<struct<pos:long,n:long>>"))
    names = schema.names
    return with_texts(known, gone, "left").unionByName(none).mapInArrow(lambda it: _result(it, width, names), schema)


def suffix_tree_dedup(docs: DataFrame, width: int = WIDTH, seed: int = SEED, tree_bytes: int = 2 << 20, group: int = GROUP) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept (the remaining words joined by one space), cut (the text without the removed words)."""
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, cut string")
    return _dedup(typed(docs, doc_id="bigint", text="string"), width, seed, tree_bytes, group, schema)


def without_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, tree_bytes: int = 2 << 20, group: int = GROUP) -> DataFrame:
    """The rows of docs with their texts cut and n_chars, where there is one, counted anew; a text of which nothing is left goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.lit(0).alias("0"), *others).alias("row")
    texts = docs.select(docs["doc_id"], docs["text"], row)
    schema = StructType([texts.schema["doc_id"], *StructType.fromDDL("n_words long, n_removed long, cut string"), texts.schema["row"]])
    out = _dedup(texts, width, seed, tree_bytes, group, schema)
    out = out.where("n_removed = 0 or n_removed < n_words")
    new = {"doc_id": F.col("doc_id"), "text": F.col("cut")}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("cut").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_tree_dedup(docs).drop("kept", "cut")


QUERIES = {NAME: query}
ORACLES = {
    NAME: r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
ws AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN f USING (s) WHERE doc_id > first),
c AS (SELECT ws.doc_id, ws.i, word, max(hit.i) OVER (PARTITION BY ws.doc_id ORDER BY ws.i ROWS UNBOUNDED PRECEDING) AS last
      FROM ws LEFT JOIN hit ON ws.doc_id = hit.doc_id AND ws.i = hit.i),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (last >= i - 12) AS gone,
             string_agg(word, ' ' ORDER BY i) FILTER (coalesce(last, -99) < i - 12) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
}
