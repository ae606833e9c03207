"""Hidden Markov language model over word classes.

Every distinct word has a class of its own if it is among the most frequent,
else the class of its first and last letters. A hidden Markov model with few
states runs over the classes; within a class a word has its smoothed share of
the class's training tokens, so the counts of all words of the corpus are part
of the model and its size grows with the corpus. What the states tell apart does
not: FREQUENT + SHAPES classes, a documented bound. Baum-Welch runs forward and
backward over whole texts; its counts are added up in each task, then over all
tasks by class. The scaled forward recursion gives the exact likelihood of each
whole text.

Words are counted without moving the tokens: each chunk of texts sends its
distinct words once, gets their counts back (those of words in many chunks by
broadcast, the others by a join), and its texts are rewritten as class
sequences, on which all rounds and the scoring run without a shuffle.

Defined results: a null or empty text is the end token alone; a null id is not
held out; rows with repeated ids are scored row by row; an empty table gives an
empty result; without training texts nothing is known and every token has the
probability of an unknown one; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import LOWER, U, block_words, counted_join, hash_ranges, spans, staged, text_buffer, typed

NAME = "op7_hidden_markov"
STATES, ROUNDS, FREQUENT, SHAPES = 8, 6, 2048, 4096
CHUNK = 12 << 20  # bytes of text whose distinct words are counted together
PIECE = 1 << 19  # tokens whose forward and backward values are held at once
_END = U(1)


def _shapes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of a word that is not frequent: its first and last two bytes, hashed."""
    last = len(buf) - 1
    a, b = buf[start], buf[end - 1]
    c = np.where(end - start > 1, buf[np.minimum(start + 1, last)], 0)
    d = np.where(end - start > 1, buf[np.maximum(end - 2, 0)], 0)
    key = ((a.astype(np.uint64) * U(257) + c) * U(257) + d) * U(257) + b
    return ((key * U(0x9E3779B97F4A7C15)) >> U(52)).astype(np.int64) % SHAPES


def _chunks(batches, size: int):
    """Two kinds of rows: a chunk's distinct words with their counts, and its texts as places in that list."""
    names = ["chunk", "word", "place", "shape", "n_train", "doc_id", "held_out", "places"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    pack = zstandard.ZstdCompressor(level=1).compress
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column(0)
        buf, offsets = text_buffer(batch.column(1))
        for first, end in spans(offsets, size):
            lo = int(offsets[first])
            data = LOWER[buf[lo : int(offsets[end])]]
            start, stop, row = block_words(data, offsets[first : end + 1] - lo)
            word = np.append(hash_ranges(data, start, stop), np.full(end - first, _END))
            row = np.append(row, np.arange(end - first))
            order = np.argsort(row, kind="stable")
            word, row = word[order], row[order]
            known, at, place = np.unique(word, return_index=True, return_inverse=True)
            shape = np.append(_shapes(data, start, stop) if len(start) else np.zeros(0, np.int64), np.zeros(end - first, np.int64))[order][at]
            own = ids.slice(first, end - first)
            held = np.array([x.is_valid and zlib.crc32(str(x.as_py()).encode()) % 5 == 1 for x in own])
            n_train = np.bincount(place[~held[row]], minlength=len(known))
            yield _rows(names, kinds, len(known), chunk=np.full(len(known), chunk), word=known.view(np.int64), place=np.arange(len(known), dtype=np.int32), shape=shape.astype(np.int32), n_train=n_train)
            cut = np.searchsorted(row, np.arange(end - first + 1))
            place = place.astype("<u4")
            yield _rows(names, kinds, end - first, chunk=np.full(end - first, chunk), doc_id=own, held_out=held, places=[pack(place[cut[i] : cut[i + 1]].tobytes()) for i in range(end - first)])
            chunk += 1


def _rows(names, kinds, size, /, **columns):
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _packed_words(batches):
    """Words of chunks as one compressed block for each chunk and about a million rows: places, classes and counts."""
    pack = zstandard.ZstdCompressor(level=1).compress
    held: list[list[np.ndarray]] = []
    size = 0

    def flush():
        chunk, place, kind, c = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, chunk))
        chunk, place, kind, c = chunk[order], place[order], kind[order], c[order]
        runs = _runs(chunk)
        blocks = [pack(np.diff(place[a:b], prepend=0).astype("<u4").tobytes() + kind[a:b].astype("<u2").tobytes() + c[a:b].astype("<i8").tobytes()) for a, b in runs]
        return pa.RecordBatch.from_arrays([pa.array(chunk[[a for a, _ in runs]]), pa.array(blocks, pa.binary())], names=["chunk", "words"])

    for batch in batches:
        held.append([batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in range(4)])
        size += len(batch)
        if size > 1 << 20:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _unpacked_words(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and counts of a chunk's words by place."""
    unpack = zstandard.ZstdDecompressor().decompress
    parts = []
    for raw in map(unpack, blocks):
        n = len(raw) // 14
        parts.append((np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<u2", n, 4 * n), np.frombuffer(raw, "<i8", n, 6 * n)))
    place, kind, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(place)
    return kind[order].astype(np.int64), c[order]


def _classed(batches, tokens: int, distinct: int, class_c: np.ndarray, class_v: np.ndarray, frequent: int):
    """Rows of a chunk, its words first: texts as class sequences, with the base score and the share within classes."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes"]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
    now, table, blocks = None, None, []
    for batch in batches:
        chunks = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in _runs(chunks):
            part = batch.slice(lo, hi - lo)
            if now != chunks[lo]:
                now, table, blocks = chunks[lo], None, []
            is_word = part.column(1).is_valid()
            blocks += part.column(1).filter(is_word).to_pylist()
            part = part.filter(pa.compute.invert(is_word))
            if not len(part):
                continue
            if table is None:
                kind, c = _unpacked_words(blocks)
                share = np.where(kind < frequent, 0, np.log10((c + 0.5) / (class_c[kind] + 0.5 * (class_v[kind] + 1))))
                table = kind.astype(np.uint16), c > 0, np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1))), share
            out: dict[str, list] = {x: [] for x in names[2:]}
            for coded in part.column(4):
                p = np.frombuffer(unpack(coded.as_py()), "<u4")
                for name, value in zip(names[2:], (len(p), int(table[1][p].sum()), float(table[2][p].sum()), float(table[3][p].sum()), table[0][p].tobytes())):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), *(pa.array(out[x], k) for x, k in zip(names[2:], kinds))], names=names)


def _runs(a: np.ndarray):
    cut = np.flatnonzero(np.diff(a)) + 1
    bounds = np.concatenate(([0], cut, [len(a)]))
    return [(int(x), int(y)) for x, y in zip(bounds[:-1], bounds[1:]) if y > x]


def side_by_side(sequences: list[np.ndarray], most: int):
    """(order, pieces): sequences by falling length, stepped through together, in pieces of time of about `most` tokens.

    A piece is (tokens, lanes): what is at each step's sequences, step after
    step, and how many sequences each step has, the longest ones first.
    """
    length = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    flat = np.concatenate([sequences[i] for i in order])
    begin = np.cumsum(length) - length
    steps = np.arange(int(length[0]))
    lanes = len(length) - np.searchsorted(length[::-1], steps, side="right")
    before = np.cumsum(lanes) - lanes
    cuts = np.flatnonzero(np.diff(before // most, prepend=-1))
    pieces = []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(steps))):
        n = lanes[lo:hi]
        lane = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pieces.append((flat[begin[lane] + np.repeat(steps[lo:hi], n)], n))
    return order, pieces


def _forward(b: np.ndarray, lanes: np.ndarray, before: np.ndarray | None, start: np.ndarray, move: np.ndarray):
    """Scaled alphas and scales of a piece; b: emission of each token, before: alphas of the step ahead of it."""
    alpha, scale = np.empty_like(b), np.empty((len(b), 1), b.dtype)
    at, a = 0, before
    for n in lanes.tolist():
        x = alpha[at : at + n]
        if a is None:
            np.multiply(start, b[at : at + n], out=x)
        else:
            np.matmul(a[:n], move, out=x)
            x *= b[at : at + n]
        s = scale[at : at + n]
        np.sum(x, axis=1, keepdims=True, out=s)
        x /= s
        a, at = x, at + n
    return alpha, scale


def expected_counts(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, most: int = PIECE):
    """Expected counts (starts, moves, emissions by state and class) of whole sequences by scaled forward and backward recursion.

    Where the sequences are longer than a piece, the forward pass keeps the
    alphas between pieces alone and each piece's are computed again when the
    backward pass comes to it.
    """
    k, kinds = emit.shape
    by_class = np.ascontiguousarray(emit.T)
    _, pieces = side_by_side(sequences, most)
    entry: list[np.ndarray | None] = [None]
    for tokens, lanes in pieces[:-1]:
        entry.append(_forward(by_class[tokens], lanes, entry[-1], start, move)[0][-lanes[-1] :].copy())
    starts, moves, out = np.zeros(k), np.zeros((k, k)), np.zeros((k, kinds))
    turned = np.ascontiguousarray(move.T)
    later = np.zeros((0, k), by_class.dtype)  # emission times beta over scale at the step behind, for the sequences that reach it
    for (tokens, lanes), before in zip(pieces[::-1], entry[::-1]):
        b = by_class[tokens]
        alpha, scale = _forward(b, lanes, before, start, move)
        beta, weight = np.ones_like(b), b / scale
        at = len(b)
        for n in lanes[::-1].tolist():
            at -= n
            np.matmul(later, turned, out=beta[at : at + len(later)])
            later = weight[at : at + n]
            later *= beta[at : at + n]
        # each token's alphas of the step before; the first step of all has none
        ahead = alpha[np.arange(int(lanes[0]), len(b)) - np.repeat(lanes[:-1], lanes[1:])]
        moves += ahead.T.astype(np.float64) @ weight[lanes[0] :]
        if before is not None:
            moves += before[: lanes[0]].T.astype(np.float64) @ weight[: lanes[0]]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        if before is None:
            starts += gamma[: lanes[0]].sum(axis=0)
        for j in range(k):
            out[j] += np.bincount(tokens, weights=gamma[:, j], minlength=kinds)
        later = later.copy()
    return starts, moves * move, out


def forward_scores(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, most: int = PIECE) -> np.ndarray:
    """log10 likelihood of whole sequences: the scaled forward recursion, over all of them side by side."""
    order, pieces = side_by_side(sequences, most)
    out = np.zeros(len(sequences))
    by_class = np.ascontiguousarray(emit.T)
    before = None
    for tokens, lanes in pieces:
        alpha, scale = _forward(by_class[tokens], lanes, before, start, move)
        lane = np.arange(len(tokens)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        out[order[: lanes[0]]] += np.bincount(lane, weights=np.log10(scale[:, 0]), minlength=lanes[0])
        before = alpha[-lanes[-1] :].copy()
    return out


def _alike(sizes: np.ndarray, most: int):
    """Groups of rows of similar size, of about `most` in sum."""
    order = np.argsort(sizes, kind="stable")
    full = (np.cumsum(sizes[order]) - sizes[order]) // most
    return np.split(order, np.flatnonzero(np.diff(full)) + 1) if len(order) else []


def _sequences(column: pa.Array, rows) -> list[np.ndarray]:
    return [np.frombuffer(column[i].as_buffer(), np.uint16) for i in rows.tolist()]


def _trained(batches, model, most: int):
    """Expected counts of a task, by class: one row for each class, and one each for starts and moves."""
    k, m = model[2].shape
    starts, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
    single = tuple(x.astype(np.float32) for x in model)
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(0)).to_numpy(zero_copy_only=False) // 2
        for rows in _alike(sizes.astype(np.int64), most):
            s, mv, e = expected_counts(_sequences(batch.column(0), rows), *single, most)
            starts += s
            moves += mv
            emitted += e
    rows = [[-1, *starts], *([-2 - i, *moves[i]] for i in range(k)), *([c, *emitted[:, c]] for c in np.flatnonzero(emitted.sum(axis=0)))]
    yield pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows]), pa.array([list(r[1:]) for r in rows], pa.list_(pa.float64()))], names=["kind", "counts"])


def _scored(batches, model, most: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    for batch in batches:
        total = batch.column(5).to_numpy(zero_copy_only=False).copy()
        sizes = pa.compute.binary_length(batch.column(6)).to_numpy(zero_copy_only=False) // 2
        for rows in _alike(sizes.astype(np.int64), most):
            total[rows] += forward_scores(_sequences(batch.column(6), rows), *model, most)
        yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(5)), pa.array(total)], names=names)


class Model:
    """start, move and emit probabilities; bounded by states x classes."""

    def __init__(self, states: int, kinds: np.ndarray, weight: np.ndarray, classes: int):
        share = np.full(classes, 0.5)
        share[kinds] += weight
        noise = np.random.default_rng(7).gamma(2.0, size=(states, classes))
        self.emit = share * noise
        self.emit /= self.emit.sum(axis=1, keepdims=True)
        self.move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.9 if states > 1 else 1.0)
        self.start = np.full(states, 1 / states)

    def parts(self):
        return self.start, self.move, self.emit

    def learn(self, counts: list) -> None:
        """One maximisation step, with half a count added to each possible event."""
        emit = np.full_like(self.emit, 0.01)
        move = np.full_like(self.move, 0.5)
        for kind, values in counts:
            if kind >= 0:
                emit[:, kind] += values
            elif kind == -1:
                self.start = (np.array(values) + 0.5) / (sum(values) + 0.5 * len(values))
            else:
                move[-2 - kind] += values
        self.emit = emit / emit.sum(axis=1, keepdims=True)
        self.move = move / move.sum(axis=1, keepdims=True)


def classed_documents(docs: DataFrame) -> tuple[DataFrame, list, int, int]:
    """(texts as class sequences, [(class, training tokens)], all training tokens, distinct training words)."""
    schema = "chunk long, word long, place int, shape int, n_train long, doc_id long, held_out boolean, places binary"
    rows = staged(typed(docs, doc_id="bigint", text="string").mapInArrow(lambda it: _chunks(it, CHUNK), schema), "chunks")
    # a word has one row for each chunk, so no word's rows grow with its tokens; sums are partial before they are dealt
    words = rows.where("word is not null").select("chunk", "word", "place", "shape", "n_train")
    totals = staged(words.groupBy("word").agg(F.sum("n_train").alias("c"), F.min("shape").alias("shape"), F.count("*").alias("chunks")), "words")
    distinct = totals.where("c > 0")
    tokens, v = distinct.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = distinct.orderBy(F.desc("c"), "word").limit(FREQUENT).select("word", (F.row_number().over(Window.orderBy(F.desc("c"), "word")) - 1).alias("top"))
    kinds = totals.join(F.broadcast(top), "word", "left").withColumn("kind", F.coalesce("top", F.col("shape") + FREQUENT))  # at most FREQUENT rows
    kinds = staged(kinds.select("word", "c", "chunks", "kind"), "kinds")
    sizes = kinds.where("c > 0").groupBy("kind").agg(F.sum("c").alias("class_c"), F.count("*").alias("class_v"))
    # at most FREQUENT + SHAPES rows; a class without training words has none
    known = [tuple(r) for r in sizes.collect()]
    class_c, class_v = np.zeros(FREQUENT + SHAPES), np.zeros(FREQUENT + SHAPES)
    for kind, c, n in known:
        class_c[kind], class_v[kind] = c, n
    placed = counted_join(words.select("chunk", "word", "place"), kinds, "word", "chunks")
    blocks = placed.select("chunk", "place", "kind", "c").mapInArrow(_packed_words, "chunk long, words binary")
    null = {x: F.lit(None).cast(t).alias(x) for x, t in (("words", "binary"), ("doc_id", "long"), ("held_out", "boolean"), ("places", "binary"))}
    both = blocks.select("chunk", "words", null["doc_id"], null["held_out"], null["places"])
    both = both.unionAll(rows.where("word is null").select("chunk", null["words"], "doc_id", "held_out", "places"))
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", F.col("words").isNull())
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"
    done = staged(dealt.mapInArrow(lambda it: _classed(it, tokens, v, class_c, class_v, FREQUENT), schema), "classes")
    return done, [r[:2] for r in known], tokens, v


def train(classes: DataFrame, sizes: list, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all texts that are not held out; each round's sums have at most FREQUENT + SHAPES + states + 1 rows."""
    kinds = np.array([k for k, _ in sizes], int)
    model = Model(states, kinds, np.array([c for _, c in sizes], float), FREQUENT + SHAPES)
    texts = classes.where("not held_out").select("classes")
    for _ in range(rounds if sizes else 0):
        parts = model.parts()
        counts = texts.mapInArrow(lambda it, parts=parts: _trained(it, parts, PIECE), "kind long, counts array<double>")
        sums = counts.groupBy("kind").agg(F.array(*[F.sum(F.col("counts")[j]) for j in range(states)]).alias("counts"))
        model.learn([(r[0], r[1]) for r in sums.collect()])
    return model


def language_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    classes, sizes, tokens, _ = classed_documents(docs)
    parts = train(classes, sizes, states, rounds).parts()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = classes.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes").mapInArrow(lambda it: _scored(it, parts, PIECE), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {NAME: query}
assert math.log2(FREQUENT + SHAPES) < 16  # class sequences are written as 16-bit numbers
