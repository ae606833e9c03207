"""Cross-tokenizer alignment against byte offsets of whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import corpus, frame

from pagewright.llm import op13_alignment as op13
from pagewright.llm.encoding import default_vocabulary, plain_encoder, token_bytes

ODD = [
    " leading", "trailing ", "  two  spaces  ", "  x  y", "a  b", "a 　b", "don't we'll  I'm", "a\tb \n c", "<|endoftext|> <s> </s><unk>", "▁ mark", "日本語 の テキスト", "\U0001f600 \U0001f468‍\U0001f469",
    "x" * 3000, " " * 3000, "ﬁ ① Å", "é é", "\x00 a", "12 345,678 -- ... !!!", "é" * 50 + " à", "a\u0085 b", "a \u0085b",
]


def plain(rows):
    """{id: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)} from whole texts and offsets."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_bytes = token_bytes(default_vocabulary())
    made, linked = {}, {}
    for k, text in enumerate(t or "" for _, t in rows):
        want = f" {text}".encode()
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        spelt = [[a_bytes[x] for x in a], [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]]
        if not text or any(b"".join(x) != want for x in spelt):
            made[k], linked[k] = (0, 0, 0, ""), []
            continue
        ends = [dict(zip(np.cumsum([len(y) for y in x]).tolist(), range(len(x)))) for x in spelt]
        groups, i, j, linked[k] = [], 0, 0, []
        for at in sorted(ends[0].keys() & ends[1].keys()):
            p, q = ends[0][at] + 1, ends[1][at] + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            linked[k].append((a[p - 1], b[q - 1]))
            i, j = p, q
        made[k] = (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(x for links in linked.values() for x in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, *made[k][:3], len(linked[k]), sum(count[x] == best[x[1]] for x in linked[k]), sum(count[x] for x in linked[k]), made[k][3]) for k, (d, _) in enumerate(rows)]


def mixed(n, seed=2):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "the", " ", " ", "é", "日", "\n", "  ", " ", "ing", "1", ",", "'s", "<", "▁" if r.random() < 0.02 else "x"]) for _ in range(r.randint(1, 200))) for _ in range(n)]


@pytest.mark.parametrize("size", [400, op13.CHUNK])
def test_alignment_equals_offsets_of_whole_texts(spark, monkeypatch, size):
    monkeypatch.setattr(op13, "CHUNK", size)
    rows = corpus(7) + [(1000 + i, t) for i, t in enumerate(ODD + mixed(150))] + [(None, "no id"), (5, "again"), (5, "again"), (5, "other words")]
    got = op13.aligned_documents(frame(spark, rows).repartition(3)).collect()
    key = lambda x: str(tuple(x))
    want = plain(rows)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert any(x[1] == 0 for x in want if x[0] and x[0] >= 1000)


def test_units_have_the_tokens_of_the_whole_text():
    encode, (library, _) = plain_encoder(default_vocabulary()), op13.pieces(op13.default_pieces())
    texts = [t for t in ODD + mixed(300, 5) if "▁" not in t]
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    data, start, stop, at = op13.cut_units(buf, offsets)
    units = [data[a:b].tobytes().decode() for a, b in zip(start, stop)]
    assert len(units) > 2 * len(texts)
    for i, t in enumerate(texts):
        own = units[at[i] : at[i + 1]]
        assert "".join(own) == f" {t}"
        assert [x for u in own for x in encode(u)] == encode(f" {t}")
        assert [x for u in own for x in library.encode(u[1:])] == library.encode(t)


def test_no_piece_reaches_across_a_word():
    library, _ = op13.pieces(op13.default_pieces())
    assert not [p for i in range(library.get_piece_size()) if "▁" in (p := library.id_to_piece(i)).lstrip("▁")]


def test_transducer_closes_groups_and_remembers_transitions():
    t = op13.Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abc", b"d", b"x"])
    assert t.groups([0, 1, 3], [0, 1, 3]) == [(2, 2), (3, 3)]
    known = t.known
    assert t.groups([0, 1, 3, 0, 1], [0, 1, 3, 0, 1]) == [(2, 2), (3, 3), (5, 5)] and t.known == known
    assert t.groups([2], [2]) == [(1, 1)] and t.groups([2], [0, 1]) == [(1, 2)]
    assert t.groups([0], [4]) is None and t.groups([0], [0]) is None and t.groups([0, 3], [0, 1]) is None and t.groups([], []) == []


def test_forgetting_transitions_changes_nothing():
    r = random.Random(8)
    tokens = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 4))) for _ in range(30)] + [b"a", b"b"]
    keeps, forgets = op13.Transducer(tokens, tokens), op13.Transducer(tokens, tokens, memo=3)

    def spelt(text):
        out = []
        while text:
            out.append(r.choice([i for i, x in enumerate(tokens) if text.startswith(x)]))
            text = text[len(tokens[out[-1]]) :]
        return out

    for _ in range(300):
        text = bytes(r.choice(b"ab") for _ in range(r.randint(1, 30)))
        a, b = spelt(text), spelt(text)
        assert keeps.groups(a, b) == forgets.groups(a, b) and keeps.groups(a, b)[-1] == (len(a), len(b))


def test_pair_table(spark):
    _, table = op13.alignments(frame(spark, [(1, "the the the cat"), (2, "the cat"), (3, None)]))
    rows = table.collect()
    assert sum(r.n for r in rows) == 6 and max(r.n for r in rows) == 4 and all(r.best == 1 for r in rows)


def test_alignment_of_an_empty_table(spark):
    assert op13.aligned_documents(frame(spark, [])).collect() == []
