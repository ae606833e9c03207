"""Fill-in-the-middle against a plain version, code point by code point."""

import hashlib
import random

import numpy as np
import pytest
from fixtures import corpus, frame

from pagewright.llm import op12_fill_in_middle as op12

SF = "/root/testdata/sf0.001"
ODD = ["<P>", "a<S>b", "<M", "x<P", "<<P>>", "<P<S<M", "é<", "日本語<P>ß", "\U0001f600" * 700, "a" * 255 + "é" * 3, "a" * 254 + "<P>", "a" * 253 + "<P>b", "é" * 128 + "日" * 300, "<" * 600, "\x00a\x00"]


def digests(text):
    return [hashlib.sha256(x.encode()).hexdigest() for x in text]


def cut(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the contract, in plain Python."""
    text, x = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in op12.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_plain_cuts(spark):
    r = random.Random(3)
    mixed = ["".join(r.choice("ab é日\U0001f600<PSM>\n") for _ in range(r.randint(1, 900))) for _ in range(120)]
    rows = corpus(5) + [(1000 + i, t) for i, t in enumerate(ODD + mixed)] + [(None, "no id"), (7000, "again"), (7000, "again"), (7000, "another")]
    made = op12.fill_in_middle(frame(spark, rows)).collect()
    want = [(d, *cut(d, t)) for d, t in rows]
    key = lambda x: str(tuple(x))
    assert sorted(made, key=key) == sorted((tuple(x) for x in want), key=key)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_restores_every_text(spark):
    rows = corpus(6) + [(1000 + i, t) for i, t in enumerate(ODD)]
    made = op12.fill_in_middle(frame(spark, rows))
    got = made.select("doc_id", op12.restored(made.output, made.form).alias("text")).collect()
    assert sorted(map(tuple, got)) == sorted((d, t or "") for d, t in rows)


def test_a_text_longer_than_a_block_is_scanned_in_pieces():
    table = op12.automaton(op12.SENTINELS)
    r = np.random.default_rng(4)
    text = "".join(r.choice(list("aé日\U0001f600< "), size=1_500_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    buf = np.concatenate([raw, np.frombuffer(b"tail", np.uint8)])
    offsets = np.array([0, len(raw), len(buf)])
    units, hits, at = op12.scanned(table, 3, buf, offsets)
    assert units[: at[1]].sum(dtype=int) == len(text) and units[at[1] :].sum(dtype=int) == 4 and not hits.any()
    cuts = np.array([0, 1, 777_777, len(text) - 1, len(text)])
    place = op12.located(table, 3, buf, offsets, units, at, np.zeros(5, int), cuts)
    assert place.tolist() == [len(text[:c].encode()) for c in cuts]


@pytest.mark.parametrize("at", [0, 1, 254, 255, 256, 511, (1 << 20) - 2, (1 << 20) - 1, 1 << 20])
def test_a_sentinel_is_found_across_strips_and_blocks(at):
    raw = np.frombuffer(b"x" * at + b"<M>" + b"y" * (2 << 20), np.uint8)
    units, hits, _ = op12.scanned(op12.automaton(op12.SENTINELS), 3, raw, np.array([0, len(raw)]))
    assert hits.sum() == 1 and units.sum(dtype=int) == len(raw)


def test_other_sentinels_and_rates(spark):
    rows = [(i, f"text {i} <P> é") for i in range(300)]
    made = op12.fill_in_middle(frame(spark, rows), ("<é>", "<éa>", "[[M]]"), plain_from=100, spm_below=50, seed=9)
    out = made.select("doc_id", "form", op12.restored(made.output, made.form, ("<é>", "<éa>", "[[M]]")).alias("text")).collect()
    assert {r.doc_id: r.text for r in out} == dict(rows) and {r.form for r in out} == {"psm", "spm"}


def test_fill_in_middle_of_an_empty_table(spark):
    assert op12.fill_in_middle(frame(spark, [])).collect() == []
