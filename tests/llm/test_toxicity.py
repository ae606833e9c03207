"""The recurrent network against slow versions of itself, and its scores on rows that it was not fitted on."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import corpus, frame

from pagewright.llm import op11_toxicity as op11

BAD = ["vilbok", "grumzat", "snarfek", "plobdin"]


def made_up(n=700, seed=1):
    """(id, text, label): syllable words; label 1 where some of the words begin with a bad stem, whatever their endings."""
    r = random.Random(seed)
    syllables = ["ta", "lo", "mi", "re", "sun", "kor", "vel", "ash", "pin", "dro"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 200))]
        bad = i % 4 == 0
        for _ in range(r.randint(1, 4) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", "", "o", "ish", "ta", "re", "!!"]))
        text = " ".join(w)
        rows.append((i, text.upper() if i % 17 == 0 else text, int(bad)))
    return rows


def plain_tokens(text):
    out, now = [], b""
    for x in (text or "").lower().encode() + b" ":
        if op11._LETTER[x]:
            now += bytes([x])
        elif now:
            out += [now[i : i + 64] for i in range(0, len(now), 64)]
            now = b""
    return out


def small_network(words=()):
    network = op11.Network(np.sort(np.array(words, np.uint64)))
    r = np.random.default_rng(3)
    for name in ("word", "gram"):
        network.p[name] = r.standard_normal(network.p[name].shape).astype(np.float32) * np.float32(0.5)
    return network


def buffers(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def slow_logit(network, words):
    """One window, one token after another, in double precision."""
    p = {k: v.astype(float) for k, v in network.p.items()}
    xs = []
    for w in words:
        data = np.frombuffer(w, np.uint8)
        grams, _ = op11.grams_of(data, np.array([0]), np.array([len(data)]))
        row = network.known(op11.hash_ranges(data, np.array([0]), np.array([len(data)])))[0]
        xs.append(np.concatenate([p["word"][row], p["gram"][grams].sum(axis=0) / np.sqrt(len(grams))]))
    sig, k, both = lambda v: 1 / (1 + np.exp(-v)), op11.HIDDEN, []
    for side, seq in ((0, xs), (1, xs[::-1])):
        h, out = np.zeros(k), []
        for x in seq:
            g, u = x @ p["into"][side] + p["bias"][side, 0], h @ p["back"][side]
            z, r = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
            h = h + z * (np.tanh(g[2 * k :] + r * u[2 * k :]) - h)
            out.append(h)
        both.append(out if side == 0 else out[::-1])
    states = np.concatenate([np.array(both[0]).reshape(-1, k), np.array(both[1]).reshape(-1, k)], axis=1)
    if not len(states):
        return p["offset"][0]
    a = np.tanh(states @ p["look"] + p["tilt"]) @ p["seek"]
    a = np.exp(a - a.max())
    return (a / a.sum()) @ states @ p["out"] + p["offset"][0]


def test_tokens_windows_and_logits_equal_a_slow_version():
    texts = [t for _, t in corpus(9, 30)] + ["É à ÀÉ×x", "a" * 200 + " b", "!!", "A-b_c", " ".join(f"w{i}" for i in range(32)), " ".join(f"w{i}" for i in range(33))]
    network = small_network()
    data, offsets = buffers(texts)
    lower, start, end, row = op11.tokens_of(data, offsets)
    got = [[lower[a:b].tobytes() for a, b, r in zip(start, end, row) if r == i] for i in range(len(texts))]
    assert got == [plain_tokens(t) for t in texts]
    top, n, best = op11.block_scores(network, data, offsets)
    for i, w in enumerate(got):
        begins = [0, *range(op11.STRIDE, len(w) - op11.WINDOW + op11.STRIDE, op11.STRIDE)] if len(w) > op11.WINDOW else [0]
        want = [slow_logit(network, w[b : b + op11.WINDOW]) for b in begins]
        assert n[i] == len(begins) and begins[-1] + op11.WINDOW >= len(w)
        assert np.allclose(top[i][: len(want)], sorted(want, reverse=True)[: op11.TOP], atol=1e-4) and np.isnan(top[i][len(want) :]).all()
        assert abs(want[best[i]] - max(want)) < 1e-4


def test_gradients_equal_differences():
    words = [f"wort{i}".encode() for i in range(9)]
    data, offsets = buffers([b" ".join(words).decode()])
    data, start, end, _ = op11.tokens_of(data, offsets)
    word, place, grams, at = op11._words(data, start, end)
    network = small_network(word[:5])
    rows = network.known(word)
    windows, _ = op11.window_places(np.array([9, 4]), np.array([0, 5]), place, len(word))
    label, share = np.array([1.0, 0.0]), np.array([1.0, 0.7])
    network.p = {k: v.astype(float) for k, v in network.p.items()}

    def loss():
        x = np.empty((len(rows), op11.WORD_SIZE + op11.GRAM_SIZE))
        x[:, : op11.WORD_SIZE] = network.p["word"][rows]
        x[:, op11.WORD_SIZE :] = [network.p["gram"][grams[a:b]].sum(axis=0) / np.sqrt(b - a) for a, b in zip(at[:-1], at[1:])]
        z = network.logits(network.projected(x).astype(float), windows)
        return float((share * (np.logaddexp(0, z) - label * z)).sum())

    grad, d_table = network.gradients(network.projected(network.inputs(rows, grams, at)), windows, label, share)
    r = np.random.default_rng(5)
    for name in ("out", "offset", "seek", "look", "tilt", "back"):
        flat = network.p[name].reshape(-1)
        for j in r.integers(0, len(flat), 6):
            kept = flat[j]
            flat[j] = kept + 1e-2
            up = loss()
            flat[j] = kept - 1e-2
            down = loss()
            flat[j] = kept
            assert abs((up - down) / 2e-2 - grad[name].reshape(-1)[j]) < 2e-3 * max(1, abs(grad[name].reshape(-1)[j]))
    flat = network.p["bias"].reshape(-1)
    for j in r.integers(0, len(flat), 10):
        flat[j] += 1e-2
        up = loss()
        flat[j] -= 2e-2
        down = loss()
        flat[j] += 1e-2
        want = d_table[:, :-1].sum(axis=1).reshape(-1)[j]
        assert abs((up - down) / 2e-2 - want) < 2e-3 * max(1, abs(want))


@pytest.mark.parametrize("size", [700, 5000])
def test_a_long_text_is_scored_in_pieces_as_in_one(size):
    r = random.Random(6)
    text = "".join(r.choice(["wort ", "a", "é ", " " * 40, "x" * 150, "!! ", "lang "]) for _ in range(3000))
    network = small_network()
    data, offsets = buffers([text])
    top, n, best = op11.block_scores(network, data, offsets)
    assert np.allclose(op11.long_scores(network, data, 100 * size)[0], top[0], atol=1e-4)
    monkey_top, m, where = op11.long_scores(network, data, 10 * size)
    assert np.allclose(monkey_top, top[0], atol=1e-4) and (m, where) == (n[0], best[0])
    for empty in ("", " " * 10_000):
        assert op11.long_scores(network, buffers([empty])[0], 1000)[1] == 1


def test_held_out_texts_are_told_apart(spark):
    rows = made_up()
    labels = spark.createDataFrame([(i, y, 1, "x") for i, _, y in rows] + [(None, 1, 1, "x")], "doc_id long, toxic int, quality int, text string")
    odd = [(9000, None), (9001, ""), (9002, "!!"), (None, "no id"), (9003, "ta lo " * 5000), (9003, "ta lo vilbok " * 10), (9004, "ta lo mi " * 200 + "grumzata " + "re sun kor " * 200)]
    got = op11.toxicity(frame(spark, [(i, t) for i, t, _ in rows] + odd), labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [(y, by_id[i].predicted) for i, _, y in rows if by_id[i].held_out]
    assert sum(y == p == 1 for y, p in held) >= 0.9 * sum(y for y, _ in held) and sum(p and not y for y, p in held) <= 0.02 * len(held)
    assert by_id[9000].score == by_id[9001].score == by_id[9002].score and not by_id[9000].predicted and by_id[9004].predicted
    assert sorted(r.predicted for r in got if r.doc_id == 9003) == [0, 1]
    # the place of what was found
    at = (by_id[9004].first_token, by_id[9004].first_token + op11.WINDOW)
    assert at[0] <= 600 < at[1]


def test_held_out_labels_do_not_matter(spark):
    rows = made_up(240)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    one, two = (spark.createDataFrame([(i, 1 - y if flip and held(i) else y) for i, _, y in rows], "doc_id long, toxic int") for flip in (False, True))
    a, b = (op11.labelled_sample(docs, x)[0].to_pylist() for x in (one, two))
    assert a == b and len(a) == sum(not held(i) for i, _, _ in rows)


def test_without_labels_of_both_kinds(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in op11.toxicity(docs, none).collect()] == [(0.5, 0)] * 2
    ones = spark.createDataFrame([(i, 0) for i in range(12)], "doc_id long, toxic int")
    assert {r.score < 0.1 for r in op11.toxicity(docs, ones).collect()} == {True}
    assert op11.toxicity(frame(spark, []), ones).collect() == []


def test_fitting_is_repeatable_and_bounded(spark):
    rows = made_up(200)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    few, _, n = op11.labelled_sample(docs, labels, sample=20)
    assert few.column("toxic").to_pylist().count(1) == 20 and len(few) == 40 and n > 100
    short = op11.labelled_sample(docs, labels, longest=300)[0]
    assert max(len(t) for t in short.column("text").to_pylist()) <= 300
    y = few.column("toxic").to_numpy()
    a, b = (op11.fitted(few.column("text"), y, 0.25, rounds=1) for _ in range(2))
    assert np.allclose(a.p["into"], b.p["into"]) and isinstance(few.column("text"), pa.ChunkedArray)
