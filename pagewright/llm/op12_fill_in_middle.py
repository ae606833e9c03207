"""Fill-in-the-middle transformation: texts cut at two units into prefix, middle and suffix, written in one of two orders.

A table-driven automaton over bytes does the work of one scan: its state holds
how many continuation bytes of a UTF-8 unit are still to come and how much of a
sentinel has been read, so each transition says whether a unit begins and
whether a sentinel ends there. Texts are laid out in strips of equal length that
are stepped through side by side; a strip starts from what the few bytes ahead
of it leave, which is all that the automaton remembers. The scan emits, for each
strip, how many of its transitions began a unit and how many ended a sentinel. A
second pass runs the automaton again over those strips alone that hold a cut and
finds the byte of it.

Texts are scanned in blocks, so a worker holds the bytes of a batch and of one
block, whatever the length of a text. There is no shuffle: a lost task is run
again from its rows.

Defined results: a null or empty text has no unit and is plain; one that holds a
sentinel anywhere is plain; a null id draws as an empty one; rows with repeated
ids are cut row by row; bytes that are no UTF-8 count as units of one byte; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, spans, text_buffer, typed

NAME = "op12_fill_in_middle"
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
STRIP = 256
END = 0xFF  # never a byte of UTF-8: what strips are filled up with
_BEGINS, _HIT = 1 << 8, 1 << 9


@functools.lru_cache(maxsize=4)
def automaton(sentinels: tuple[str, ...]) -> np.ndarray:
    """table[state * 256 + byte]: the next state, with flags for a unit that begins and a sentinel that ends."""
    marks = [s.encode() for s in sentinels]
    begun = {m[:i] for m in marks for i in range(len(m) + 1)}
    number = {(0, b""): 0}
    todo, rows = [(0, b"")], []
    while len(rows) < len(todo):
        wanted, read = todo[len(rows)]
        row = np.zeros(256, np.uint16)
        for byte in range(256):
            if byte == END:
                continue
            goes_on = wanted > 0 and 0x80 <= byte < 0xC0
            then = wanted - 1 if goes_on else 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3 if byte < 0xF8 else 0
            seen = read + bytes([byte])
            held = next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in begun)
            state = (then, held)
            if state not in number:
                number[state] = len(todo)
                todo.append(state)
            row[byte] = number[state] | (0 if goes_on else _BEGINS) | (_HIT if any(held.endswith(m) for m in marks) else 0)
        rows.append(row)
    if len(rows) > 256:
        raise ValueError("the sentinels are too long for states of one byte")
    return np.concatenate(rows)


def stepped(table: np.ndarray, ahead: np.ndarray, strips: np.ndarray):
    """The transitions of each step of all strips; ahead: the bytes before each strip. Both have one row for each byte."""
    state = np.zeros(strips.shape[1], np.uint16)
    for column in ahead:
        state = (table[state | column] & 0xFF) << 8
    for column in strips:
        out = table[state | column]
        yield out
        state = (out & 0xFF) << 8


def counted(table: np.ndarray, memory: int, buf: np.ndarray, lo: int, hi: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Units that begin and sentinels that end in each strip of buf[lo:hi], which belongs to a text that starts at first."""
    n = -(-(hi - lo) // STRIP)
    strips = np.full((n, STRIP), END, np.uint8)
    strips.reshape(-1)[: hi - lo] = buf[lo:hi]
    ahead = np.full((n, memory), END, np.uint8)
    ahead[1:] = strips[:-1, STRIP - memory :]
    before = buf[max(first, lo - memory) : lo]
    ahead[0, memory - len(before) :] = before
    return totals(table, ahead, strips)


def totals(table: np.ndarray, ahead: np.ndarray, strips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    units, hits = np.zeros(len(strips), np.uint16), np.zeros(len(strips), np.uint16)
    for out in stepped(table, np.ascontiguousarray(ahead.T), np.ascontiguousarray(strips.T)):
        units += (out >> 8) & 1
        hits += out >> 9
    return units, hits


def scanned(table: np.ndarray, memory: int, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units of each strip, sentinels of each strip, first strip of each text and the end), texts laid out one after another."""
    strips = -(-np.diff(offsets) // STRIP)
    at = np.concatenate(([0], np.cumsum(strips)))
    units, hits = np.zeros(at[-1], np.uint16), np.zeros(at[-1], np.uint16)
    for first, end in spans(offsets):
        if end == first + 1:
            for lo in range(int(offsets[first]), int(offsets[end]), BLOCK):
                hi = min(lo + BLOCK, int(offsets[end]))
                k = at[first] + (lo - int(offsets[first])) // STRIP
                u, h = counted(table, memory, buf, lo, hi, int(offsets[first]))
                units[k : k + len(u)], hits[k : k + len(h)] = u, h
            continue
        laid = np.full((int(at[end] - at[first]), STRIP), END, np.uint8)
        flat = laid.reshape(-1)
        for i in range(first, end):
            k = int(at[i] - at[first]) * STRIP
            flat[k : k + int(offsets[i + 1] - offsets[i])] = buf[offsets[i] : offsets[i + 1]]
        ahead = np.full((len(laid), memory), END, np.uint8)
        ahead[1:] = laid[:-1, STRIP - memory :]
        ahead[(at[first:end] - at[first])[strips[first:end] > 0]] = END
        units[at[first] : at[end]], hits[at[first] : at[end]] = totals(table, ahead, laid)
    return units, hits, at


def located(table: np.ndarray, memory: int, buf: np.ndarray, offsets: np.ndarray, units: np.ndarray, at: np.ndarray, rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The place in buf at which the unit after the first `cuts` units of the text of each row begins; the text's end if there is none."""
    place = offsets[rows + 1].copy()
    before = np.concatenate(([0], np.cumsum(units, dtype=np.int64)))
    wanted = before[at[rows]] + cuts + 1  # that unit, counted over all texts
    inside = wanted <= before[at[rows + 1]]
    for lo in range(0, int(inside.sum()), BLOCK // STRIP):
        part = np.flatnonzero(inside)[lo : lo + BLOCK // STRIP]
        strip = np.searchsorted(before, wanted[part], side="left") - 1
        begin = offsets[rows[part]] + (strip - at[rows[part]]) * STRIP
        where = begin[:, None] + np.arange(-memory, STRIP)
        outside = (where < offsets[rows[part]][:, None]) | (where >= offsets[rows[part] + 1][:, None])
        data = buf[np.minimum(np.maximum(where, 0), len(buf) - 1)]
        data[outside] = END
        data = np.ascontiguousarray(data.T)
        begins = np.stack([(out >> 8) & 1 for out in stepped(table, data[:memory], data[memory:])])
        reached = np.cumsum(begins, axis=0, dtype=np.int32) >= (wanted[part] - before[strip])[None, :]
        place[part] = begin + reached.argmax(axis=0)
    return place


def _transformed(batches, sentinels, plain_from: int, spm_below: int):
    table, memory = automaton(sentinels), max(3, *(len(s.encode()) - 1 for s in sentinels))
    p, s, m = (x.encode() for x in sentinels)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    for batch in batches:
        every, bounds = text_buffer(batch.column(1))
        draws = [batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(2, 6)]
        for first, end in spans(bounds, 8 * BLOCK):
            offsets = bounds[first : end + 1] - bounds[first]
            buf = every[int(bounds[first]) : int(bounds[end])]
            h1, h2, h3, h4 = (x[first:end] for x in draws)
            units, hits, at = scanned(table, memory, buf, offsets)
            upto = np.concatenate(([0], np.cumsum(units, dtype=np.int64)))
            found = np.concatenate(([0], np.cumsum(hits, dtype=np.int64)))
            n = upto[at[1:]] - upto[at[:-1]]
            plain = (n == 0) | (found[at[1:]] > found[at[:-1]]) | (h3 % 100 >= plain_from)
            spm = h4 % 100 < spm_below
            low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
            rows = np.flatnonzero(~plain)
            a, b = (located(table, memory, buf, offsets, units, at, rows, x[rows]) for x in (low, high))
            begin, stop = offsets[rows], offsets[rows + 1]
            data, size = memoryview(buf), np.diff(offsets)
            size[rows] += sum(map(len, (p, s, m)))
            place = {int(r): k for k, r in enumerate(rows)}
            parts = []
            for i in range(end - first):
                if (k := place.get(i)) is None:
                    parts.append(data[offsets[i] : offsets[i + 1]])
                    continue
                prefix, middle, suffix = data[begin[k] : a[k]], data[a[k] : b[k]], data[b[k] : stop[k]]
                parts += (s, suffix, p, prefix, m, middle) if spm[i] else (p, prefix, s, suffix, m, middle)
            ends = np.concatenate(([0], np.cumsum(size)))
            output = pa.StringArray.from_buffers(end - first, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(parts)))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            chars = [pa.array(x, mask=plain) for x in (low, high - low)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n), pa.array(form, pa.string()), *chars, output], names=names)


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the hash of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, seed: int = 1) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output."""
    rows = typed(docs, doc_id="bigint", text="string")
    rows = rows.select("doc_id", "text", *drawn(F.col("doc_id"), seed))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(lambda it: _transformed(it, tuple(sentinels), plain_from, spm_below), schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of, told from the two alone: its parts have no sentinel in them."""
    p, s, m = sentinels
    upto = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    psm = F.concat(after(upto(output, s), p), after(output, m), upto(after(output, s), m))
    spm = F.concat(after(upto(output, m), p), after(output, m), after(upto(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES = {NAME: query}
ORACLES = {
    NAME: """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
    SELECT *, ('0x' || x[1:8])::UBIGINT % (n + 1) AS c1, ('0x' || x[9:16])::UBIGINT % (n + 1) AS c2, ('0x' || x[17:24])::UBIGINT % 100 AS h3, ('0x' || x[25:32])::UBIGINT % 100 AS h4 FROM d
), f AS (
    SELECT doc_id, t, n, least(c1, c2)::BIGINT AS a, greatest(c1, c2)::BIGINT AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), p AS (
    SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p"""
}
