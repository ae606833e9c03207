"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A token is a run of letters and digits, lower-cased. Its input is a learned
vector of the word, if the sample knows it, beside the mean of learned vectors of
its character n-grams, so that unseen forms of known stems still tell. Every
window of WINDOW tokens, one at every STRIDE, is read in both directions; states
are pooled by attention into one logit. A document's score comes from its
highest windows by a logistic regression of two inputs.

The network is fitted on a bounded sample of the labelled rows that are not held
out: at most SAMPLE of either label, in order of a hash of their ids, texts of at
most SAMPLE_BYTES. Labels belong to whole texts, so fitting starts with all
windows of a text under its label and goes on with those that the network itself
rates highest. A fifth of the sample is kept from the network for the regression.

Scoring is one pass over all rows and whole texts without a shuffle, in blocks of
bounded size; what a block's distinct words put into the network is computed once
for each of them.

Defined results: a null or empty text, or one without letters, is one window
without tokens; a null id is not held out and has no label; of several labels of
an id the highest counts; rows with repeated ids are scored row by row; without
labels of both kinds every score is the smoothed share of label 1; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, LOWER, U, hash_ranges, spans, text_buffer, typed

NAME = "op11_toxicity"
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_SIZE, GRAM_SIZE, ATTENTION = 8, 12, 12, 8
WORDS, GRAMS, GRAM_LENGTHS = 8192, 1 << 15, (3, 5, 7)
LONGEST = 64  # bytes of a token; a longer run is read as several
SAMPLE, SAMPLE_BYTES = 2000, 1 << 14
THRESHOLD = 0.7
LANES = 2048  # windows that are read side by side
TOP = 3  # windows that a document's score comes from
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, rows) of the tokens of adjacent texts; a run is cut every LONGEST bytes."""
    data = LOWER[data]
    # capitals of Latin-1 in UTF-8
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[wide] += 32
    inside = _LETTER[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    parts = -(-(end - start) // LONGEST)
    if len(parts) and parts.max() > 1:
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(end, parts)
        start = np.repeat(start, parts) + nth * LONGEST
        end = np.minimum(start + LONGEST, stop)
    return data, start, end, np.searchsorted(offsets, start, side="right") - 1


def grams_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the n-gram table, first entry of each word and the end): the words' n-grams with a mark at either end."""
    size = end - start + 2
    at = np.concatenate(([0], np.cumsum(size)))
    laid = np.zeros(int(at[-1]) + max(GRAM_LENGTHS), np.uint64)
    inner = np.ones(int(at[-1]), bool)
    inner[at[:-1]] = False
    inner[at[1:] - 1] = False
    # words lie in data in the order of their starts, or not; each is copied by its own places
    places = np.repeat(start - at[:-1] - 1, size)[inner] + np.flatnonzero(inner)
    laid[: at[-1]][inner] = data[places]
    laid[at[:-1]], laid[at[1:] - 1] = 1, 2
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(at[1:], size) - np.arange(int(at[-1]))
    rows, owners, h = [], [], np.zeros(int(at[-1]), np.uint64)
    for k in range(max(GRAM_LENGTHS)):
        h = h * U(0x100000001B3) + laid[k : k + len(h)] + U(1)
        if k + 1 in GRAM_LENGTHS:
            # a word shorter than the shortest is one n-gram with its marks
            whole = left >= k + 1
            if k + 1 == min(GRAM_LENGTHS):
                whole |= (left == np.repeat(size, size)) & (left < k + 1)
            rows.append(((h[whole] * U(0x9E3779B97F4A7C15)) >> U(64 - GRAMS.bit_length() + 1)).astype(np.int64))
            owners.append(word[whole])
    order = np.argsort(np.concatenate(owners), kind="stable")
    owner = np.concatenate(owners)[order]
    return np.concatenate(rows)[order], np.searchsorted(owner, np.arange(len(size) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over the runs between the places of at, none of which is empty."""
    return np.add.reduceat(values, at[:-1], axis=0) if len(at) > 1 else np.zeros((0, *values.shape[1:]), values.dtype)


def _scattered(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of values by row."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    if len(first):
        out[rows[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """The parameters, the forward pass over windows of places in a table of projected words, and one step of fitting."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        n = WORD_SIZE + GRAM_SIZE
        self.vocabulary = vocabulary  # sorted hashes of the words with a vector of their own, which is not at 0
        self.p = {
            "word": np.zeros((len(vocabulary) + 1, WORD_SIZE), np.float32), "gram": np.zeros((GRAMS, GRAM_SIZE), np.float32),
            "into": draw(2, n, 3 * HIDDEN), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32), "back": draw(2, HIDDEN, 3 * HIDDEN),
            "look": draw(2 * HIDDEN, ATTENTION), "tilt": np.zeros(ATTENTION, np.float32), "seek": draw(ATTENTION, 1)[:, 0],
            "out": draw(2 * HIDDEN, 1)[:, 0], "offset": np.zeros(1, np.float32),
        }
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.steps = 0
        self.regression = np.array([1.0, 0.0, 0.0])  # of the highest window, the mean of the highest TOP, and one

    def known(self, words: np.ndarray) -> np.ndarray:
        """The row of the word table of each hash; 0 for a word without one."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def inputs(self, rows: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = np.empty((len(rows), WORD_SIZE + GRAM_SIZE), np.float32)
        x[:, :WORD_SIZE] = self.p["word"][rows]
        for lo in range(0, len(rows), 1 << 14):
            hi = min(lo + (1 << 14), len(rows))
            x[lo:hi, WORD_SIZE:] = _sums(self.p["gram"][grams[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]) / np.sqrt(np.diff(at[lo : hi + 1]))[:, None]
        return x

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What each word puts into the gates of both directions; last a row that leaves every state as it is."""
        table = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
        np.matmul(x, self.p["into"], out=table[:, :-1])
        table[:, :-1] += self.p["bias"]
        table[:, -1, :HIDDEN] = -30.0
        return table

    def logits(self, table: np.ndarray, windows: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """A logit for each column of windows, which are places in the table; kept: gets what the backward pass needs."""
        size, n = windows.shape
        h, g = np.zeros((2, n, HIDDEN), np.float32), np.empty((2, n, 3 * HIDDEN), np.float32)
        states = np.empty((size, n, 2 * HIDDEN), np.float32)
        back, steps = self.p["back"], []
        for t in range(size):
            np.take(table[0], windows[t], axis=0, out=g[0])
            np.take(table[1], windows[size - 1 - t], axis=0, out=g[1])
            u = np.matmul(h, back)
            gates = _sigmoid(g[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
            z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
            new = np.tanh(g[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
            if kept is not None:
                steps.append((h, gates, new, u[..., 2 * HIDDEN :]))
            h = h + z * (new - h)
            states[t, :, :HIDDEN], states[size - 1 - t, :, HIDDEN:] = h[0], h[1]
        seen = np.tanh(states @ self.p["look"] + self.p["tilt"])
        weight = seen @ self.p["seek"]
        weight[windows == table.shape[1] - 1] = -1e9
        weight -= weight.max(axis=0)
        np.exp(weight, out=weight)
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if kept is not None:
            kept |= {"steps": steps, "states": states, "seen": seen, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["offset"][0]

    def gradients(self, table: np.ndarray, windows: np.ndarray, label: np.ndarray, share: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of all but the inputs' parameters, gradient of the table) of the weighted cross-entropy."""
        kept: dict = {}
        size, n = windows.shape
        logit = self.logits(table, windows, kept)
        d = ((1 / (1 + np.exp(-logit)) - label) * share).astype(np.float32)
        states, seen, weight = kept["states"], kept["seen"], kept["weight"]
        grad = {"out": kept["pooled"].T @ d, "offset": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * self.p["out"]
        d_weight = np.einsum("nk,tnk->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_seen = d_score[..., None] * self.p["seek"] * (1 - seen * seen)
        grad["seek"] = np.einsum("tn,tna->a", d_score, seen)
        grad["look"] = np.einsum("tnk,tna->ka", states, d_seen)
        grad["tilt"] = d_seen.sum(axis=(0, 1))
        d_states = weight[..., None] * d_pooled + d_seen @ self.p["look"].T
        back = self.p["back"]
        grad["back"] = np.zeros_like(back)
        d_table = np.zeros((2, size, n, 3 * HIDDEN), np.float32)
        dh = np.zeros((2, n, HIDDEN), np.float32)
        turned = np.ascontiguousarray(back.transpose(0, 2, 1))
        for t in range(size - 1, -1, -1):
            h, gates, new, u = kept["steps"][t]
            z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
            dh[0] += d_states[t, :, :HIDDEN]
            dh[1] += d_states[size - 1 - t, :, HIDDEN:]
            d_new = dh * z * (1 - new * new)
            dg = d_table[:, t]
            dg[..., :HIDDEN] = dh * (new - h) * z * (1 - z)
            dg[..., HIDDEN : 2 * HIDDEN] = d_new * u * r * (1 - r)
            du = dg.copy()
            du[..., 2 * HIDDEN :] = d_new * r
            dg[..., 2 * HIDDEN :] = d_new
            grad["back"] += np.matmul(h.transpose(0, 2, 1), du)
            dh = dh * (1 - z) + np.matmul(du, turned)
        places = [windows.reshape(-1), windows[::-1].reshape(-1)]
        return grad, np.stack([_scattered(places[k], d_table[k].reshape(-1, 3 * HIDDEN), table.shape[1]) for k in range(2)])

    def step(self, rows: np.ndarray, grams: np.ndarray, at: np.ndarray, windows: np.ndarray, label: np.ndarray, share: np.ndarray, rate: float) -> None:
        """One step of Adam on windows of places in a list of words with these rows and n-grams."""
        x = self.inputs(rows, grams, at)
        grad, d_table = self.gradients(self.projected(x), windows, label, share)
        d_table = d_table[:, :-1]
        grad["into"], grad["bias"] = np.matmul(x.T, d_table), d_table.sum(axis=1, keepdims=True)
        dx = np.matmul(d_table, self.p["into"].transpose(0, 2, 1)).sum(axis=0)
        grad["word"] = _scattered(rows, dx[:, :WORD_SIZE], len(self.p["word"]))
        grad["word"][0] = 0
        count = np.diff(at)
        grad["gram"] = _scattered(grams, np.repeat(dx[:, WORD_SIZE:] / np.sqrt(count)[:, None], count, axis=0), GRAMS)
        self.steps += 1
        for name, g in grad.items():
            g = g / np.float32(max(1, len(label)))
            m, v = self.moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            scale = np.float32(rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
            self.p[name] -= scale * m / (np.sqrt(v) + np.float32(1e-8))

    def document_scores(self, top: np.ndarray) -> np.ndarray:
        """Scores of documents from their TOP highest windows' logits, highest first; missing ones are nan."""
        x = top[:, 0] * self.regression[0] + np.nanmean(top, axis=1) * self.regression[1] + self.regression[2]
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def windows_of(count: np.ndarray) -> np.ndarray:
    """How many windows texts of so many tokens have."""
    return np.maximum(0, -(-(count - WINDOW) // STRIDE)) + 1


def window_places(count: np.ndarray, first: np.ndarray, place: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows as columns of places, row of each): texts of count tokens, whose places begin at first."""
    n = windows_of(count)
    row = np.repeat(np.arange(len(n)), n)
    begin = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    at = begin[None, :] + np.arange(WINDOW)[:, None]
    inside = at < count[row]
    return np.where(inside, np.append(place, pad)[np.where(inside, at + first[row], len(place))], pad), row


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(distinct words' hashes, place of each token among them, n-grams, their bounds)."""
    word, one, place = np.unique(hash_ranges(data, start, end), return_index=True, return_inverse=True)
    grams, at = grams_of(data, start[one], end[one])
    return word, place, grams, at


def _logits(network: Network, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return np.concatenate([network.logits(table, np.ascontiguousarray(windows[:, lo : lo + LANES])) for lo in range(0, windows.shape[1], LANES)])


def highest(logit: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(the TOP highest logits of each row, nan where there are fewer; which window of the row is highest)."""
    order = np.lexsort((-logit, row))
    first = np.searchsorted(row[order], np.arange(rows + 1))
    top = np.full((rows, TOP), np.nan)
    for k in range(TOP):
        has = first[:-1] + k < first[1:]
        top[has, k] = logit[order[first[:-1][has] + k]]
    begin = np.searchsorted(row, np.arange(rows))
    return top, order[first[:-1]] - begin


def block_scores(network: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(TOP logits, windows, the highest one) of each of adjacent texts."""
    data, start, end, row = tokens_of(data, offsets)
    word, place, grams, at = _words(data, start, end)
    table = network.projected(network.inputs(network.known(word), grams, at))
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    windows, owner = window_places(count, np.searchsorted(row, np.arange(rows)), place, len(word))
    top, best = highest(_logits(network, table, windows), owner, rows)
    return top, windows_of(count), best


def long_scores(network: Network, data: np.ndarray, size: int = 2 * BLOCK) -> tuple[np.ndarray, int, int]:
    """The same of one long text, in pieces of about `size` bytes that begin at the first token of a window."""
    # of each run without letters one byte is left, so a piece has as many tokens as fit
    keep = np.ones(len(data), bool)
    for lo in range(1, len(data), size):
        hi = min(lo + size, len(data))
        keep[lo:hi] = _LETTER[data[lo:hi]] | _LETTER[data[lo - 1 : hi - 1]]
    data = data[keep]
    lo, done, top, best, best_logit = 0, 0, np.full(TOP, np.nan), 0, -np.inf
    while True:
        hi = min(lo + size, len(data))
        piece, start, end, _ = tokens_of(data[lo:hi], np.array([0, hi - lo]))
        last = hi == len(data)
        full = len(start) if last else (len(start) - 1 - WINDOW) // STRIDE * STRIDE + WINDOW  # the last token may go on
        word, place, grams, at = _words(piece, start[:full], end[:full])
        table = network.projected(network.inputs(network.known(word), grams, at))
        windows, owner = window_places(np.array([full]), np.array([0]), place, len(word))
        here, where = highest(_logits(network, table, windows), owner, 1)
        if here[0, 0] > best_logit:
            best, best_logit = done + int(where[0]), here[0, 0]
        both = np.concatenate([top, here[0]])
        both = -np.sort(-both)  # falling, nan last
        top, done = both[:TOP], done + windows.shape[1]
        if last:
            return top, done, best
        lo += int(start[windows.shape[1] * STRIDE])


def _scored(batches, network: Network | None, prior: float, threshold: float):
    names = ["doc_id", "held_out", "score", "predicted", "n_windows", "first_token"]
    for batch in batches:
        buf, bounds = text_buffer(batch.column(1))
        for first, end in spans(bounds, 2 * BLOCK):
            ids, rows = batch.column(0).slice(first, end - first), end - first
            data, offsets = buf[int(bounds[first]) : int(bounds[end])], bounds[first : end + 1] - bounds[first]
            if network is None:
                score, n, best = np.full(rows, prior), np.zeros(rows, int), np.zeros(rows, int)
            elif len(data) > 2 * BLOCK:
                top, n, best = (np.array([x]) for x in long_scores(network, data))
                score = network.document_scores(top)
            else:
                top, n, best = block_scores(network, data, offsets)
                score = network.document_scores(top)
            held = [x.is_valid and zlib.crc32(str(x.as_py()).encode()) % 3 == 1 for x in ids]
            predicted = (score >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(score), pa.array(predicted), pa.array(n.astype(np.int64)), pa.array(best.astype(np.int64) * STRIDE)], names=names)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = SAMPLE_BYTES) -> tuple[pa.Table, int, int]:
    """(texts and labels of the sample, rows labelled 1, all labelled rows that are not held out)."""
    fit = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    own = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fit)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ones, rows = own.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    by = F.xxhash64("doc_id")
    chosen = own.where("toxic = 1").orderBy(by, "doc_id").limit(sample).unionAll(own.where("toxic = 0").orderBy(by, "doc_id").limit(sample))
    texts = typed(docs, doc_id="bigint", text="string").where(F.octet_length("text") <= longest)
    # at most 2 * sample ids; a repeated id may bring more rows, of which again as many are taken
    found = texts.join(F.broadcast(chosen), "doc_id").orderBy(by, "doc_id", F.xxhash64("text")).limit(2 * sample)
    return found.select("text", "toxic").toArrow(), int(ones), int(rows)


def fitted(texts: pa.ChunkedArray, toxic: np.ndarray, share: float, rounds: int = 5, seed: int = 11) -> Network:
    """The network and its regression, from a sample with both labels; share: of label 1 among all labelled rows."""
    r = np.random.default_rng(seed)
    buf, bounds = text_buffer(texts)
    offsets = bounds - bounds[0]
    data, start, end, row = tokens_of(buf[int(bounds[0]) : int(bounds[-1])], offsets)
    word, place, grams, at = _words(data, start, end)
    rows = len(offsets) - 1
    apart = np.arange(rows) % 5 == 4
    if len(set(toxic[apart])) < 2 or len(set(toxic[~apart])) < 2:
        apart = np.zeros(rows, bool)
    in_texts = np.bincount(np.unique(place[~apart[row]] * rows + row[~apart[row]]) // rows, minlength=len(word)) if len(place) else np.zeros(0, int)
    often = np.argsort(-in_texts, kind="stable")[:WORDS]
    network = Network(np.sort(word[often[in_texts[often] > 1]]))
    known = network.known(word)
    count = np.bincount(row, minlength=rows)
    windows, owner = window_places(count, np.searchsorted(row, np.arange(rows)), place, len(word))
    label = toxic[owner].astype(np.float32)
    usable = np.flatnonzero(~apart[owner])

    def learn(chosen: np.ndarray, rate: float) -> None:
        chosen = r.permutation(chosen)
        ones = max(1, int(label[chosen].sum()))
        weight = np.where(label == 1, 0.5 * len(chosen) / ones, 0.5 * len(chosen) / max(1, len(chosen) - ones)).astype(np.float32)
        for lo in range(0, len(chosen), 192):
            part = chosen[lo : lo + 192]
            some, local = np.unique(windows[:, part], return_inverse=True)
            local = local.reshape(WINDOW, len(part))
            if some[-1] == len(word):
                some = some[:-1]
            else:  # no window is filled up; the row for that comes last all the same
                local = local.copy()
            size = np.diff(at)[some]
            own = np.repeat(at[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            hidden = np.where(r.random(len(some)) < 0.3, 0, known[some])  # so that n-grams learn to do without the word
            network.step(hidden, grams[own], np.concatenate(([0], np.cumsum(size))), local, label[part], weight[part], rate)

    learn(usable[r.permutation(len(usable))][: 12 * rows], 0.01)
    for turn in range(rounds):
        logit = _logits(network, network.projected(network.inputs(known, grams, at)), windows)
        order = np.lexsort((-logit, owner))
        nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        # of a text with label 1 the highest window; of one with label 0 the highest ones and some other
        take = order[np.where(label[order] == 1, nth < 1 + (turn == 0), (nth < 3) | (r.random(len(order)) < 0.05))]
        learn(take[~apart[owner[take]]], 0.01 if turn < rounds - 2 else 0.003)
    top, _ = highest(_logits(network, network.projected(network.inputs(known, grams, at)), windows), owner, rows)
    judged = apart if apart.any() else ~apart
    x = np.stack([top[:, 0], np.nanmean(top, axis=1), np.ones(rows)], axis=1)[judged]
    y = toxic[judged]
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    network.regression = _regression(x, y, weight)
    return network


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton's method, drawn a little to (0.5, 0.5, 0)."""
    centre = np.array([0.5, 0.5, 0.0])
    b = centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + (b - centre) * np.array([1.0, 1.0, 0.01])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1.0, 0.01])
        b = b - np.clip(np.linalg.solve(h, g), -2, 2)
    return b


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_windows and first_token, the token at which its highest window begins."""
    rows, ones, n = labelled_sample(docs, labels, sample)
    share, network = (ones + 0.5) / (n + 1), None
    toxic = rows.column("toxic").to_numpy()
    if len(set(toxic)) == 2:
        network = fitted(rows.column("text"), toxic, share)
        network.moments = {}
    schema = "doc_id long, held_out boolean, score double, predicted int, n_windows long, first_token long"
    return typed(docs, doc_id="bigint", text="string").mapInArrow(lambda it: _scored(it, network, share, threshold), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))


QUERIES = {NAME: query}
