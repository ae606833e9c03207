"""Alignment of two tokenizers' tokens by a dangling-suffix transducer, and how often each pair of ids is linked.

Both token sequences of a text are read against each other. The state is which
side leads and the bytes by which it does: the dangling suffix, or residual. The
side that lags reads its next token; the token eats the residual or outruns it,
and an empty residual closes a group, whose last tokens are a link. A transition
depends on the residual and the next token alone, so it is computed once and
then looked up; residuals are suffixes of tokens, so there are no more of them
than the vocabularies have bytes.

Texts are read in units: from a space that follows other than white space up to
the next such space. No token of either vocabulary reaches across that space, so
a text's tokens are those of its units one after another and every unit ends on
an empty residual. A chunk of texts encodes and aligns each of its distinct units
once; a text's groups, counts and digest are put together from its units.

Each chunk sends its distinct linked pairs once with their counts and gets their
corpus-wide counts back, those of pairs in many chunks by broadcast, the others
by a join. What is moved grows with the chunks' distinct pairs, not with links.

Defined results: a null or empty text, and one whose joined tokens are not its
bytes (white space that a vocabulary changes, its word mark, broken UTF-8), has
no tokens, all counts zero and an empty digest; strings of special tokens are
plain text; rows with null or repeated ids are aligned row by row; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import bounded, counted_join, hash_ranges, spans, staged, text_buffer, typed
from .encoding import default_vocabulary, plain_encoder, token_bytes

NAME = "op13_cross_tokenizer_alignment"
CHUNK = 12 << 20  # bytes of text whose distinct units are aligned together
MEMO = 1 << 18  # transitions that a worker remembers; beyond, it begins anew
JOINED = 1 << 16  # units whose groups are written at once
ALIGNED = 1 << 14  # units that are aligned at once
_WORD_MARK = "▁"
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of characters that are no white space in any script.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """The piece vocabulary as its library reads it, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(_WORD_MARK, " ").encode() for i, x in enumerate(names)]


class Transducer:
    """Reads tokens of two vocabularies against each other; states are (side that leads, residual)."""

    def __init__(self, a: list[bytes], b: list[bytes], memo: int = MEMO):
        self.tokens, self.memo = (a, b), memo
        self._forget()

    def _forget(self) -> None:
        self.state_of = {(0, b""): 0}
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.moves: list[dict[int, int]] = [{}]
        self.lags = [0]  # the side that reads next
        self.known = 0

    def _move(self, state: int, token: int) -> int:
        """The state after the lagging side has read a token; -1 if its bytes are not those that the other side has."""
        leads, residual = self.states[state]
        side = self.lags[state]
        read = self.tokens[side][token]
        if residual.startswith(read):
            then = (leads, residual[len(read) :])
        elif read.startswith(residual):
            then = (side, read[len(residual) :])
        else:
            then = None
        if then is None:
            to = -1
        elif not then[1]:
            to = 0
        elif (to := self.state_of.get(then)) is None:
            to = self.state_of[then] = len(self.states)
            self.states.append(then)
            self.moves.append({})
            self.lags.append(1 - then[0])
        self.moves[state][token] = to
        self.known += 1
        return to

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """The ends (tokens of a, tokens of b) of the groups; None if the two do not spell the same bytes."""
        if self.known > self.memo:
            self._forget()
        sides, at, state, out = (a, b), [0, 0], 0, []
        moves, lags = self.moves, self.lags
        while at[0] < len(a) or at[1] < len(b):
            side = lags[state]
            i = at[side]
            if i == len(sides[side]):
                return None
            at[side] = i + 1
            token = sides[side][i]
            to = moves[state].get(token)
            state = self._move(state, token) if to is None else to
            if not state:
                out.append((at[0], at[1]))
            elif state < 0:
                return None
        return None if state else out


def written(a: list[int], b: list[int], ends: list[tuple[int, int]]) -> str:
    """Groups as text: ids of a, a bar, ids of b; a semicolon between groups."""
    parts, i, j = [], 0, 0
    for p, q in ends:
        parts.append(f"{a[i]}|{b[j]}" if p == i + 1 and q == j + 1 else f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
        i, j = p, q
    return ";".join(parts)


@functools.lru_cache(maxsize=2)
def _aligner(vocabulary: str, model: str):
    """A function from units, each with its leading space, to (tokens of a, tokens of b, groups' text, links); None for what has no tokens."""
    encode, (library, b_bytes) = plain_encoder(vocabulary), pieces(model)
    a_bytes = token_bytes(vocabulary)
    reader = Transducer(a_bytes, b_bytes)

    def align(units: list[bytes]) -> list[tuple[int, int, str, list[int]] | None]:
        texts = [u.decode("utf-8", "replace") for u in units]
        out = []
        for raw, text, b in zip(units, texts, library.encode([t[1:] for t in texts], num_threads=1)):
            a = encode(text)
            ends = reader.groups(a, b)
            if not ends or b"".join([a_bytes[x] for x in a]) != raw:
                out.append(None)
            else:
                out.append((len(a), len(b), written(a, b, ends), [a[i - 1] << 32 | b[j - 1] for i, j in ends]))
        return out

    return align


def cut_units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, first unit of each text): texts with a space put ahead, cut before single spaces between other than white space."""
    n = len(offsets) - 1
    data = np.full(int(offsets[-1] - offsets[0]) + n, 32, np.uint8)
    text = np.ones(len(data), bool)
    head = offsets[:-1] - offsets[0] + np.arange(n)
    text[head] = False
    data[text] = buf[int(offsets[0]) : int(offsets[-1])]
    cut = np.zeros(len(data), bool)
    cut[1:-1] = (data[1:-1] == 32) & ~_WHITE[data[:-2]] & _SOLID[data[2:]]
    # a text's first byte is no cut of the text before, nor is its last byte with the space of the next one
    cut[head] = True
    start = np.flatnonzero(cut)
    return data, start, np.append(start[1:], len(data)), np.append(np.searchsorted(start, head), len(start))


_NAMES = ["chunk", "kind", "place", "pair", "n", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "data"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_SCHEMA = "chunk long, kind int, place int, pair long, n long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, data binary"
PAIR, UNITS, TEXT = 0, 1, 2


def _rows(size: int, /, **columns) -> pa.RecordBatch:
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(_NAMES, _TYPES)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _aligned(batches, vocabulary: str, model: str, size: int):
    """Rows of three kinds for each chunk: its linked pairs with their counts, the pairs of its units, and its texts as units."""
    align, pack = _aligner(vocabulary, model), zstandard.ZstdCompressor(level=1).compress
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        buf, bounds = text_buffer(batch.column(1))
        for first, end in spans(bounds, size):
            docs = end - first
            data, start, stop, at = cut_units(buf, bounds[first : end + 1])
            _, one, place = np.unique(hash_ranges(data, start, stop), return_index=True, return_inverse=True)
            raw = data.tobytes()
            text, (n_a, n_b, n_links), links = _found(align, raw, start[one], stop[one])
            whole = np.diff(bounds[first : end + 1]) > 0
            whole &= ~np.logical_or.reduceat(n_links[place] == 0, at[:-1])
            of_text = np.repeat(np.arange(docs), np.diff(at))
            uses = np.bincount(place[whole[of_text]], minlength=len(text))
            unit = np.repeat(np.arange(len(text)), n_links)
            pair, number = np.unique(links, return_inverse=True)
            n = np.bincount(number, weights=uses[unit], minlength=len(pair)).astype(np.int64)  # exact below 2 ** 53
            yield _rows(len(pair), chunk=np.full(len(pair), chunk), kind=np.full(len(pair), PAIR, np.int32), place=np.arange(len(pair), dtype=np.int32), pair=pair, n=n)
            yield _rows(1, chunk=[chunk], kind=[UNITS], data=[pack(n_links.astype("<u4").tobytes() + number.astype("<u4").tobytes())], n=[len(text)])
            digest, held = [], []
            for i in range(docs):
                p = place[at[i] : at[i + 1]] if whole[i] else place[:0]
                held.append(pack(p.astype("<u4").tobytes()))
                digest.append(_digest(text, p) if whole[i] else "")
            total = [np.where(whole, np.add.reduceat(x[place], at[:-1]), 0) for x in (n_a, n_b, n_links)]
            yield _rows(docs, chunk=np.full(docs, chunk), kind=np.full(docs, TEXT, np.int32), doc_id=batch.column(0).slice(first, docs), n_a=total[0], n_b=total[1], n_groups=total[2], groups_sha256=digest, data=held)
            chunk += 1


def _found(align, raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(groups' text of each unit, its tokens of either side and links, all links); units without tokens have none."""
    text: list[str] = []
    sizes, links = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(start), ALIGNED):
        found = align([raw[a:b] for a, b in zip(start[lo : lo + ALIGNED].tolist(), stop[lo : lo + ALIGNED].tolist())])
        text += [x[2] if x else "" for x in found]
        sizes.append(np.array([(x[0], x[1], len(x[3])) if x else (0, 0, 0) for x in found], np.int64))
        links.append(np.array([p for x in found if x for p in x[3]], np.int64))
    return text, np.concatenate(sizes).T, np.concatenate(links)


def _digest(text: list[str], units: np.ndarray) -> str:
    out, ahead = hashlib.sha256(), b""
    for lo in range(0, len(units), JOINED):
        out.update(ahead + ";".join([text[p] for p in units[lo : lo + JOINED].tolist()]).encode())
        ahead = b";"
    return out.hexdigest()


def _counted(batches):
    """A chunk's texts with the sums over their links; its pairs, by place, and its units come first."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    now, pairs, sums = None, [], None
    for batch in batches:
        chunks, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        edge = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1
        for lo, hi in zip(np.concatenate(([0], edge)).tolist(), [*edge.tolist(), len(batch)]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if now != chunks[lo]:
                now, pairs, sums = chunks[lo], [], None
            if kinds[lo] == PAIR:
                pairs.append([part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4)])
            elif kinds[lo] == UNITS:
                place, n, best = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
                value = np.zeros((2, len(place)), np.int64)
                value[:, place] = n, best
                raw, size = unpack(part.column(5)[0].as_py()), part.column(6)[0].as_py()
                links, number = np.frombuffer(raw, "<u4", size).astype(np.int64), np.frombuffer(raw, "<u4", offset=4 * size)
                upto = np.concatenate(([0], np.cumsum(links)))
                run = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(value[:, number], axis=1)), axis=1)
                sums, pairs = run[:, upto[1:]] - run[:, upto[:-1]], []
            else:
                units = [np.frombuffer(unpack(x.as_py()), "<u4") for x in part.column(5)]
                count, best = (pa.array([int(s[u].sum()) for u in units], pa.int64()) for s in sums)
                own = [part.column(i) for i in range(7, 12)]
                yield pa.RecordBatch.from_arrays([*own[:4], own[3], best, count, own[4]], names=names)


def alignments(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of chunks, pair table): the table has pair, a, b, n (links corpus-wide), chunks and best (1 if no pair of b has more)."""
    first, second = vocabulary or default_vocabulary(), model or default_pieces()
    rows = staged(typed(docs, doc_id="bigint", text="string").mapInArrow(lambda it: _aligned(it, first, second, CHUNK), _SCHEMA), "alignments")
    pairs = rows.where(f"kind = {PAIR}").select("pair", "n")
    totals = staged(pairs.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("chunks")), "pairs")
    totals = totals.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n", "chunks")
    most = totals.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of the second vocabulary
    return rows, totals.join(bounded(most), "b").withColumn("best", (F.col("n") == F.col("most")).cast("int")).drop("most")


def aligned_documents(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows, table = alignments(docs, vocabulary, model)
    counts = staged(table.select("pair", F.col("n").alias("count"), "best", "chunks"), "counts")
    placed = counted_join(rows.where(f"kind = {PAIR}").select("chunk", "kind", "place", "pair"), counts, "pair", "chunks")
    null = lambda **types: [F.lit(None).cast(t).alias(c) for c, t in types.items()]
    rest = ["data", "n", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    kinds = {"data": "binary", "groups_sha256": "string"}
    both = placed.select("chunk", "kind", "place", "count", "best", *null(**{c: kinds.get(c, "long") for c in rest}))
    both = both.unionAll(rows.where(f"kind <> {PAIR}").select("chunk", "kind", *null(place="int", count="long", best="int"), *rest))
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "kind")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return dealt.mapInArrow(_counted, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {NAME: query}
