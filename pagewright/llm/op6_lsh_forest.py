"""MinHash near-dedup with an LSH forest.

Each document's set of word shingles gives one MinHash signature; a tree of the
forest is an order of the signatures by its own sequence of values. All orders
are sorted, over ranges, so that no key is in one task alone; neighbours' common
prefixes are measured on the way. Candidates are, for each document, the one of
its neighbours in all trees that shares the longest prefix, and the least
document of all its regions. Connected components of the confirmed links settle most regions (runs
that share DEPTHS[0] values) for good. A region that still has several
components is compared across them if it is sparse; where it is crowded,
so are the deeper runs in it, of DEPTHS[1] values, that are sparse. Documents of
crowded regions are besides looked up in an exact index of their rarest
shingles: two sets of the least similarity share one among as many of the rarest
as either may have to itself. So crowding costs no link, and depth none either.
Pairs are looked at only if their sizes and, in the index, what is left of both
behind the shingle allow the similarity, and their signatures' last bits do not
rule it out. Documents of one template, each with some words of its own, are told
apart by their places in the index before any pair is made.

The chance that a link of the least similarity is never compared is below 1e-6;
there is no cap on partners or candidates.

Equal sets are one class from the start. Links are confirmed on full shingle
sets (64-bit hashes of shingles, no signature estimate).

Defined results: a null or empty text, or one of white space alone, has an
empty set and is linked with nothing; with fewer words than a shingle the
whole sequence is the one shingle; rows with a null id are returned as their
own, unlinked, with a null component; rows of one id are one document, which is
linked with what any of its texts is similar to, and share their component; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import LOWER, U, block_words, counted_join, discarded, hash_ranges, mix, spans, staged, text_buffer, typed

NAME = "op6_lsh_forest_dedup"
SHINGLE, VALUES = 3, 256
DEPTHS, MISS = (4, 8), 4e-7  # values that a region shares, more where it is crowded; chance that a pair of the least similarity shares no region of the first depth
DENSE = 32  # documents of a region that is not crowded
PART = 4096  # rows of a shingle in the index that are looked up together
_rng = np.random.default_rng(6)
_MUL = _rng.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)



def orders(percent: int) -> np.ndarray:
    """The trees' orders of signature values, one a row: as many trees as the chance to miss asks for, 20 at 85 per cent and 28 at 80."""
    trees = math.ceil(math.log(MISS) / math.log(1 - (min(percent, 99) / 100) ** DEPTHS[0]))
    return np.array([[(t * DEPTHS[0] + j) % VALUES for j in range(DEPTHS[-1])] for t in range(trees)])


def most_odd_bits(percent: int) -> int:
    """How many of the VALUES last bits may differ: at Jaccard 0.85 some 19 do, and more than these 43 with probability 2e-7."""
    p = (1 - percent / 100) / 2
    return math.floor(VALUES * p + 5.65 * math.sqrt(VALUES * p * (1 - p)))


_BITS = [f"bits{i}" for i in range(VALUES // 64)]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int, fold: bool = True):
    """Blocks (first row, end row, row, hash): the distinct shingle hashes of each row, in order."""
    for first, end in spans(offsets):
        lo = int(offsets[first])
        data = buf[lo : int(offsets[end])]
        if fold:
            data = LOWER[data]
        start, stop, row = block_words(data, offsets[first : end + 1] - lo)
        words = hash_ranges(data, start, stop)
        n = len(words)
        hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if n >= k:
            h = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                h = h * U(0x9FB21C651E98DF25) + words[j : n - k + 1 + j]
            same = row[: n - k + 1] == row[k - 1 :]
            hashes.append(mix(h[same]))
            rows.append(row[: n - k + 1][same])
        count = np.bincount(row, minlength=end - first)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            at = np.concatenate(([0], np.cumsum(count)))[short]
            h = np.full(len(short), 77, np.uint64)
            for j in range(k - 1):
                use = count[short] > j
                h[use] = h[use] * U(0xA24BAED4963EE407) + words[at[use] + j]
            hashes.append(mix(h ^ U(0x5555)))
            rows.append(short)
        h, r = np.concatenate(hashes), np.concatenate(rows)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        yield first, end, r[new], h[new]


def _binary(a: np.ndarray, width: int) -> pa.Array:
    flat = np.ascontiguousarray(a)
    offsets = np.arange(0, (len(a) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _signed(batches, k: int):
    names = ["doc_id", "n_shingles", "fp", "sig", *_BITS]
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        for first, end, row, h in shingle_sets(buf, offsets, k):
            m = end - first
            count = np.bincount(row, minlength=m)
            has = np.flatnonzero(count)
            fp = np.zeros((m, 2), np.uint64)
            sig = np.zeros((m, VALUES), np.uint16)
            if len(has):
                at = np.concatenate(([0], np.cumsum(count)))[has]
                fp[has, 0] = np.add.reduceat(mix(h), at)
                fp[has, 1] = np.add.reduceat(mix(h ^ U(0xC2B2AE3D27D4EB4F)), at)
                x = (h >> U(32)).astype(np.uint32)
                for j, (a, b) in enumerate(zip(_MUL, _XOR)):
                    sig[has, j] = np.minimum.reduceat((x ^ b) * a, at) & np.uint32(0xFFFF)
            empty = pa.array(count == 0)
            null = pa.scalar(None, pa.binary())
            fps, sigs = _binary(fp, 16), _binary(sig, 2 * VALUES)
            bits = np.packbits(sig & 1, axis=1).view(np.int64)
            if len(has) < m:
                fps, sigs = (pa.compute.if_else(empty, null, x) for x in (fps, sigs))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, m), pa.array(count.astype(np.int64)), fps, sigs, *map(pa.array, bits.T.copy())], names=names)


def _signatures(column: pa.Array) -> np.ndarray:
    buf, offsets = text_buffer(column)
    return buf[offsets[0] : offsets[-1]].view(np.uint16).reshape(len(column), -1)


def _planted(batches, trees: np.ndarray):
    """A row for each tree: its number and the signature's values in its order, so that rows sort as the tree does."""
    for batch in batches:
        sig = _signatures(batch.column(1)).astype(">u2")
        rep = batch.column(0).to_numpy(zero_copy_only=False)
        for first in range(0, len(trees), 8):
            rows = trees[first : first + 8]
            path = np.empty((len(rows), len(rep), 1 + trees.shape[1]), ">u2")
            path[:, :, 0] = np.arange(first, first + len(rows))[:, None]
            for i, order in enumerate(rows):
                path[i, :, 1:] = sig[:, order]
            yield pa.RecordBatch.from_arrays([_binary(path.reshape(-1, path.shape[2]), 2 * path.shape[2]), pa.array(np.tile(rep, len(rows)))], names=["path", "rep"])


def _neighbours(batches, depth: int):
    """Over a range of sorted orders, rows (a, b, shared): each document's neighbours with the values shared (depth or more), and with shared null its region's least document.

    A region is a run that shares `depth` values; where it does not end with a
    batch, its pieces' least documents are linked. One further row of the first
    and last documents' pieces and paths.
    """
    ends, before, head = None, None, 0
    for batch in batches:
        path, rep = _signatures(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(rep):
            continue
        known = before is not None
        ahead = np.concatenate((before[0] if known else path[:1], path[:-1]))
        prev = np.concatenate((before[1] if known else rep[:1], rep[:-1]))
        shared = np.cumprod(ahead == path, axis=1).sum(axis=1) - 1  # values below the tree's root
        if not known:
            shared[0] = -1
        starts = np.flatnonzero(np.concatenate(([True], shared[1:] < depth)))
        least = np.minimum.reduceat(rep, starts)
        a, b = [np.repeat(least, np.diff(np.append(starts, len(rep))))], [rep]
        if known and shared[0] >= depth:
            a.append(least[:1])
            b.append(np.array([head]))
        if ends is None:
            ends = [least[0], batch.column(0)[0].as_py()]
        a, b = np.concatenate(a), np.concatenate(b)
        star = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b], axis=0)
        near = (shared >= depth) & (prev != rep)
        yield _near_rows(star[:, 0], star[:, 1])
        yield _near_rows(np.concatenate((rep[near], prev[near])), np.concatenate((prev[near], rep[near])), np.tile(shared[near], 2))
        before, head, last = (path[-1:].copy(), rep[-1:].copy()), least[-1], batch.column(0)[-1].as_py()
    if ends is not None:
        yield _near_rows(np.array([ends[0]]), np.array([head]), None, [ends[1]], [last])


def _near_rows(a, b, shared=None, head=None, tail=None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    shared = pa.nulls(len(a), pa.int32()) if shared is None else pa.array(shared, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), shared, none if head is None else pa.array(head, pa.binary()), none if tail is None else pa.array(tail, pa.binary())], names=["a", "b", "shared", "head", "tail"])


def near_pairs(forest: DataFrame, depth: int) -> DataFrame:
    """(a, b): each document with the one that shares the longest prefix with it in any tree, and with the least one of all its regions; forest: path, rep."""
    dealt = forest.repartitionByRange("path", "rep").sortWithinPartitions("path", "rep")
    near = staged(dealt.mapInArrow(lambda it: _neighbours(it, depth), "a long, b long, shared int, head binary, tail binary"), "near")
    # one row a range, not a document: the last piece of each with the first of the next
    ends = sorted((bytes(r["head"]), r["a"], bytes(r["tail"]), r["b"]) for r in near.where("head is not null").collect())
    across = [(a, b) for (_, _, tail, b), (head, a, _, _) in zip(ends, ends[1:]) if a != b and tail[: 2 * depth + 2] == head[: 2 * depth + 2]]
    best = near.where("shared is not null").groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    least = near.where("shared is null and head is null").groupBy("b").agg(F.min("a").alias("a"))
    pairs = least.select("a", "b").unionByName(best)
    if across:
        pairs = pairs.unionByName(forest.sparkSession.createDataFrame(across, "a long, b long"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _confirmed(batches, k: int, percent: int):
    """Pairs with both texts: those whose full sets are similar enough."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sets = []
        for c in (2, 3):
            buf, offsets = text_buffer(batch.column(c))
            # equal neighbours, as a region's first document brings them, are cut into shingles once
            found: list[np.ndarray] = []
            for first, end, row, h in shingle_sets(buf, offsets, k):
                cut = np.searchsorted(row, np.arange(end - first + 1))
                found += [h[cut[i] : cut[i + 1]] for i in range(end - first)]
            sets.append(found)
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(*sets)):
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                both = np.sort(np.concatenate((x, y)))
                inter = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * inter >= percent * (len(x) + len(y) - inter)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _links(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose documents' sets are similar; the texts are dealt by id once for both sides."""
    left = pairs.hint("shuffle_hash").join(docs.withColumnRenamed("doc_id", "b").withColumnRenamed("text", "text_b"), "b")
    both = docs.withColumnRenamed("doc_id", "a").withColumnRenamed("text", "text_a").join(left.hint("shuffle_hash"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirmed(it, k, percent), "a long, b long")


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component): the least node that can be reached; alternating large and small stars.

    Each round is two aggregations and joins over the links; nothing comes to
    the driver but the number of links that changed.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = staged(small.select("e.*").where("u <> v").distinct(), name)
        moved = new.join(edges, ["u", "v"], "left_anti").limit(1).count()
        discarded(edges)
        edges = new
        if not moved:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _sets(batches, k: int):
    """All shingle hashes of each document, in order, and their number."""
    for batch in batches:
        buf, offsets = text_buffer(batch.column(2))
        for first, end, row, h in shingle_sets(buf, offsets, k):
            bounds = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64)))
            # tells the texts of one id apart
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h))))
            key = total[bounds[1:]] - total[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(np.diff(bounds).astype(np.int64)), pa.array(key.view(np.int64)), sets], names=["rep", "c", "n", "key", "hashes"])


def _odd_bits() -> Column:
    return sum((F.bit_count(F.col(f"x_{k}").bitwiseXOR(F.col(f"y_{k}"))) for k in _BITS), F.lit(0))


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components within a region; members: region, rep, c, n_shingles and bits, and of the index place.

    What is outside a region's largest component is paired with all others in
    it: pairs within a component need no comparison. What cannot be similar is
    ruled out in the join, so that no pairs but likely links come out of it.

    In the index, rows of a shingle stand at a place in their documents' order:
    two documents that meet at their first common shingle share no more than
    what is left of either behind it, so each bounds the size of the other. A
    document whose bound is below its own size is heavy: two heavy ones cannot be
    similar and never meet. A crowded shingle's rows are dealt over parts.
    """
    indexed = "place" in members.columns
    sizes = members.groupBy("region", "c").agg(F.count("*").alias("rows"))
    main = sizes.groupBy("region").agg(F.max_by("c", F.struct("rows", "c")).alias("main"), F.count("*").alias("parts"), F.sum("rows").alias("rows")).where("parts > 1")
    names = [c for c in members.columns if c != "region"]
    left, right = "c <> main", "true"
    if indexed:
        members = members.withColumn("bound", (F.col("n_shingles") - F.col("place")) * (100 + percent) - F.col("n_shingles") * percent)  # percent times the largest size of a partner
        names.append("bound")
        main = main.withColumn("parts", F.ceil(F.col("rows") / PART).cast("int"))
        light = F.col("bound") >= F.col("n_shingles") * percent
        # kind 0: light documents on the right, kind 1: heavy ones, which only light ones look up
        x_kind, y_kind = F.when(light, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))), F.when(light, 0).otherwise(1)
        x_part, y_part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    else:
        x_kind, y_kind, x_part, y_part = F.array(F.lit(0)), F.lit(0), F.lit(0), F.lit(0)
    open_ = members.hint("merge").join(main.select("region", "main", "parts"), "region")
    x = open_.where(left).select("region", F.explode(x_kind).alias("kind"), x_part.alias("part"), *[F.col(k).alias(f"x_{k}") for k in names])
    y = open_.where(right).select("region", "main", y_kind.alias("kind"), y_part.alias("part"), *[F.col(k).alias(f"y_{k}") for k in names])
    wanted = (F.col("x_c") != F.col("y_c")) & ((F.col("y_c") == F.col("main")) | (F.col("x_rep") < F.col("y_rep")))
    wanted &= F.least("x_n_shingles", "y_n_shingles") * 100 >= F.greatest("x_n_shingles", "y_n_shingles") * percent
    if indexed:
        wanted &= (F.col("y_n_shingles") * percent <= F.col("x_bound")) & (F.col("x_n_shingles") * percent <= F.col("y_bound"))
    wanted &= _odd_bits() <= most_odd_bits(percent)
    same = (x["region"] == y["region"]) & (x["kind"] == y["kind"]) & (x["part"] == y["part"])
    return x.hint("merge").join(y, same & wanted).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def _indexed(sets: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """The index of crowded regions: (region, rep, c, n_shingles, place, bits), a row for each of a document's first shingles.

    Shingles are ordered with those first that one component alone has, then by
    how many documents have them. Any set of the least similarity has one of a
    document's first shingles among its own first ones; those of one component
    come first and cannot be it, so they have no rows but move the places.
    """
    tokens = sets.select("rep", "c", "key", F.explode("hashes").alias("region"))
    held = tokens.groupBy("region").agg(F.count("*").alias("docs"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    held = staged(held.select("region", "docs", F.col("docs").alias("weight")), "held")
    met = counted_join(tokens.select("rep", "key", "region"), held, "region", "weight").where("docs is not null")
    met = met.groupBy("rep", "key").agg(F.sort_array(F.collect_list(F.struct("docs", "region"))).alias("met"))
    rows = sets.select("rep", "c", "n", "key").hint("merge").join(met, ["rep", "key"]).hint("merge").join(size.withColumn("n", F.col("n_shingles")), ["rep", "n"])
    own = F.col("n") - F.size("met")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - own
    rows = rows.withColumn("own", own).where(first > 0).select("rep", "c", "n_shingles", "own", *_BITS, F.posexplode(F.slice("met", F.lit(1), first.cast("int"))).alias("nth", "at"))
    return rows.select(F.col("at.region").alias("region"), "rep", "c", "n_shingles", (F.col("own") + F.col("nth")).alias("place"), *_BITS)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"set_{c}"))
    both = pairs.hint("merge").join(side("b"), "b").hint("merge").join(side("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(common * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _open_pairs(forest: DataFrame, reps: DataFrame, docs: DataFrame, comp: DataFrame, k: int, percent: int) -> tuple[list[DataFrame], DataFrame | None]:
    """(pairs to look at, links): pairs across the components of sparse regions, and of sparse deeper runs of crowded ones; links of crowded regions from the index; forest: path, rep."""
    size = reps.select("rep", "n_shingles", *_BITS)
    placed = forest.join(comp, F.col("rep") == F.col("node"), "left").select("path", "rep", F.coalesce("component", "rep").alias("c"))
    found, crowded = [], None
    for depth in DEPTHS:
        placed = placed.withColumn("region", F.xxhash64(F.substring("path", 1, 2 * depth + 2)))
        if crowded is not None:
            placed = placed.hint("merge").join(crowded.select(F.col("region").alias("outer")), "outer", "left_semi")
        placed = staged(placed, "placed")
        open_ = placed.groupBy("region").agg(F.count("*").alias("crowd"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
        open_ = staged(open_.select("region", "crowd"), "open")
        members = placed.hint("merge").join(open_.where(F.col("crowd") <= DENSE).select("region"), "region").hint("merge").join(size, "rep")
        found.append(staged(_across(staged(members.select("region", "rep", "c", "n_shingles", *_BITS), "members"), percent), "cross"))
        if crowded is None:
            crowded = open_.where(F.col("crowd") > DENSE)
            if crowded.isEmpty():
                return found, None
            dense = staged(placed.hint("merge").join(crowded.select("region"), "region").select("rep", "c").distinct(), "dense")
        placed = placed.withColumnRenamed("region", "outer")
    texts = docs.withColumnRenamed("doc_id", "rep").hint("merge").join(dense, "rep").select("rep", "c", "text")
    sets = staged(texts.mapInArrow(lambda it: _sets(it, k), "rep long, c long, n long, key long, hashes array<long>"), "sets")
    pairs = staged(_across(staged(_indexed(sets, size, percent), "index"), percent), "cross")
    return found, staged(_similar(pairs, sets, percent).distinct(), "similar")


def near_dedup(docs: DataFrame, k: int = SHINGLE, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, and set_id, equal for documents of equal sets.

    The number of trees follows from percent; from 65 on the first ones use
    each signature value once.
    """
    texts = typed(docs, doc_id="bigint", text="string")
    schema = "doc_id long, n_shingles long, fp binary, sig binary, " + ", ".join(f"{x} long" for x in _BITS)
    signed = staged(texts.mapInArrow(lambda it: _signed(it, k), schema), "signatures")
    known = signed.where("fp is not null and doc_id is not null")
    classes = staged(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = known.withColumnRenamed("doc_id", "rep").join(classes.select("fp", "rep"), ["fp", "rep"], "left_semi").dropDuplicates(["fp"])
    trees = orders(percent)
    forest = staged(reps.select("rep", "sig").mapInArrow(lambda it: _planted(it, trees), "path binary, rep long"), "forest")
    pairs = staged(near_pairs(forest, DEPTHS[0]).distinct(), "pairs")
    ids = texts.where(F.col("doc_id").isNotNull())
    # ids with several texts: all their classes are one document's
    several = known.groupBy("doc_id").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    same = several.select("doc_id", F.explode("fps").alias("fp")).join(classes.select("fp", "rep"), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = staged(_links(pairs, ids, k, percent).unionByName(same.where("a <> b")), "links")
    comp = components(links, "stars")
    found, similar = _open_pairs(forest, reps, ids, comp, k, percent)
    cross = found[0]
    for more in found[1:]:
        cross = cross.unionByName(more)
    more = _links(cross.distinct().hint("merge").join(pairs, ["a", "b"], "left_anti"), ids, k, percent)
    more = staged(more if similar is None else more.unionByName(similar), "links")
    if not more.isEmpty():
        comp = components(links.unionByName(more), "stars")
    place = classes.join(comp, F.col("rep") == F.col("node"), "left").select("fp", "n", F.col("rep").alias("set_id"), F.coalesce("component", "rep").alias("component"))
    place = staged(place, "place")
    out = counted_join(signed.where("fp is not null").select("doc_id", "n_shingles", "fp"), place, "fp", "n")
    empty = signed.where("fp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"), F.col("doc_id").alias("set_id"))
    # a class that has rows without an id takes no part through them
    mine = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    out = out.select("doc_id", "n_shingles", mine("component"), mine("set_id")).unionByName(empty)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"), "set_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dedup(docs).drop("set_id")


QUERIES = {NAME: query}
ORACLES = {
    NAME: r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(root, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT root, b FROM r JOIN e ON e.a = node WHERE b > root),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON node = d.doc_id"""
}
