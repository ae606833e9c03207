"""Extraction, language model, packing, histogram and the pipeline against plain versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import corpus, frame, lower, words

from pagewright.llm import blocks, encoding
from pagewright.llm import op4_html_extraction as op4
from pagewright.llm import op7_hidden_markov as op7
from pagewright.llm import op8_hilbert_packing as op8
from pagewright.llm import op10_length_histogram as op10
from pagewright.llm.encoding import default_vocabulary, encoded

SF = "/root/testdata/sf0.001"


def tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_ids_equal_the_json_vocabulary():
    import pyarrow as pa

    texts = [t for _, t in corpus(8)] + ["a <|endoftext|> b", "<|endoftext|>", "  x y  ", "日本語 ß\r\n\t", "don't I'll 12345 ***"]
    assert [x.tolist() for x in encoded(pa.array(texts, pa.string()), default_vocabulary())] == tokens(texts)


@pytest.mark.parametrize("run", [" " * 600_000, "\n" * 600_000, "\t" * 600_000, " \n\t" * 200_000, "\u00a0" * 300_000])
def test_long_white_space_is_encoded_by_the_json_vocabulary(spark, run):
    """The pattern matcher of the faster library refuses such runs."""
    rows = [(1, f"a b{run}c d"), (2, run), (3, "a")]
    check_packing(rows, op8.pack(frame(spark, rows)).collect())
    n = Counter(len(t) for t in tokens([t for _, t in rows]))
    assert {r.length: r.n_docs for r in op10.length_histogram(frame(spark, rows)).collect()} == n


def test_vocabularies_without_merge_ranks_are_read_as_json():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoding.ranked(path) is None
    assert encoding.encoder(path)("some words").tolist() == encoding.whole(path).encode("some words", add_special_tokens=False).ids
    assert encoding.ranked(default_vocabulary()) is not None


PAGES = (
    ("<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two.<br>Three<p><b>Four</article><footer>f</footer>", "T & U One two. Three Four"),
    ("<div class='cookie-banner'>We use cookies on all of these many pages for you</div><main><p>Short.</p></main><div id=comments><p>I like this very much and so does my whole family at home</p></div>", "Short."),
    ("<article><p>a<script>var x='</p>';</script> b</p><!-- <p>no</p> --><style>p{}</style><form><label>Name</label></form><aside>ad</aside></article>", "a b"),
    ("<article><p>un<i>der</i>lined <a href=x>linked words only here</a></p></article>", "underlined linked words only here"),
    (None, ""), ("", ""), ("<p", ""), ("<article>x", "x"), ("<!-- never closed <p>a</p>", ""),
)


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert op4.main_text(page) == text


def test_extraction_of_the_test_pages(spark):
    import html
    import re

    for r, p in zip(op4.query(spark, SF).orderBy("page_id").collect(), spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()):
        inner = re.search(r"(?s)<article>(.*)</article>", p.html)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split()) and r.n_chars == len(r.text)


def nodes(tree):
    return [] if isinstance(tree, bool) else [tree[0], *nodes(tree[2]), *nodes(tree[3])]


def test_neighbours_decide():
    """The fitted tree splits on features of the blocks before and after, and the same short line is judged by what surrounds it."""
    assert set(nodes(op4.trained_tree())) & {2, 3, 4, 5}
    long = "The old mill at the river was rebuilt after the flood, and its wheel now drives a small dynamo for the village."
    inside = f"<div>{long}</div><div>It still turns.</div><div>{long}</div>"
    outside = "<div><a href=1>One</a></div><div>It still turns.</div><div><a href=2>Two</a></div>"
    assert op4.main_text(inside) == f"{long} It still turns. {long}" and op4.main_text(outside) == ""


def test_terms_that_articles_use_do_not_remove_their_paragraphs():
    text = "The parties shall settle every dispute that arises from this treaty by talks."
    for name in ("legal-text", "discussion", "notice", "tags"):
        assert op4.main_text(f'<article><h1>A treaty</h1><div class="{name}"><p>{text}</p></div><p>It holds.</p></article>') == f"A treaty {text} It holds."
    assert op4.main_text(f'<article><p>{text}</p><div class="comments"><p>{text}</p></div></article>') == text


def test_held_out_pages_of_the_labelled_table():
    """Each labelled page is judged by a tree that was fitted to the others."""
    right = total = 0
    for i, page in enumerate(op4.LABELLED):
        tree = op4.trained_tree(op4.LABELLED[:i] + op4.LABELLED[i + 1 :])
        found = op4.blocks(page)
        want = [b.text[0] == "+" for b in found]
        right += sum(a == b for a, b in zip(op4.apply_tree(tree, op4.features(found)), want))
        total += len(found)
    assert right / total > 0.95
    bare = [p for p in op4.LABELLED if not any(b.inside or b.against for b in op4.blocks(p))]
    assert 3 * len(bare) >= len(op4.LABELLED)


def test_pages_without_telling_markup(spark):
    """The generated pages with all telling tags and classes taken out: most words of the article are found, few others."""
    import html
    import re

    total = rows = 0
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        want = Counter(html.unescape(re.sub("<[^>]*>", " ", re.search(r"(?s)<article>(.*)</article>", p.html)[1])).split())
        page = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", p.html).replace(' class="ad"', "")
        got = Counter(op4.main_text(page).split())
        total += 2 * sum((got & want).values()) / (sum(got.values()) + sum(want.values()))
        rows += 1
    assert total / rows > 0.9


@pytest.mark.parametrize("unit", ["<p title='", '<p title="', "<div>", "<a ", "<p '>", "<p \"'>", "</section><div>", "<!-- ", "<script>", "<b", "<", "</", "<p>x</p>", "&amp;"])
def test_reading_takes_linear_time(unit):
    import time

    def seconds(n):
        start = time.process_time()
        op4.main_text(unit * (n // len(unit)))
        return time.process_time() - start

    seconds(50_000)
    assert seconds(800_000) < 5 + 40 * seconds(50_000)
    assert seconds(800_000) < 12


def test_odd_pages(spark):
    page = "<article><p>One two.</p></article>"
    rows = [(1, "u", page, "x", 3), (1, "u", page, "x", 3), (None, None, page, None, None), (2, "v", None, "y", 4), (3, "w", page + "<p>" + "word " * 300_000, "z", 5)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    out = op4.extract(table)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((str(r.page_id), r.url, r.text[:8], r.n_chars) for r in out.collect())
    assert got[:4] == [("1", "u", "One two.", 8)] * 2 + [("2", "v", "", 0), ("3", "w", "One two.", 8 + 300_000 * 5)]
    assert got[4] == ("None", None, "One two.", 8)


def test_scaled_recursion_equals_the_sum_over_all_paths():
    r = np.random.default_rng(1)
    k, m = 3, 4
    start, move, emit = (r.dirichlet(np.ones(n), size) for n, size in ((k, None), (k, k), (m, k)))
    for seq in ([0], [1, 2], [3, 0, 0, 2], [1] * 5):
        paths = [()]
        for _ in seq:
            paths = [(*p, s) for p in paths for s in range(k)]
        p = sum(start[x[0]] * math.prod(emit[s, t] for s, t in zip(x, seq)) * math.prod(move[a, b] for a, b in zip(x, x[1:])) for x in paths)
        got = op7.forward_scores([np.array(seq), np.array([2])], start, move, emit)
        assert got[0] == pytest.approx(math.log10(p)) and got[1] == pytest.approx(math.log10((start * emit[:, 2]).sum()))


@pytest.mark.parametrize("most", [1 << 19, 5, 1])
def test_expected_counts_equal_the_sum_over_all_paths(most):
    r = np.random.default_rng(2)
    k, m = 2, 5
    start, move, emit = r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(m), k)
    sequences = [np.array(x) for x in ([0, 1, 2, 3, 4, 0, 1], [2], [3, 3, 1], [4, 0, 2, 2, 1, 0, 3])]
    starts, moves, out = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
    for seq in sequences:
        paths = [()]
        for _ in seq:
            paths = [(*p, s) for p in paths for s in range(k)]
        p = np.array([start[x[0]] * math.prod(emit[s, t] for s, t in zip(x, seq)) * math.prod(move[a, b] for a, b in zip(x, x[1:])) for x in paths])
        for x, share in zip(paths, p / p.sum()):
            starts[x[0]] += share
            for a, b in zip(x, x[1:]):
                moves[a, b] += share
            for s, t in zip(x, seq):
                out[s, t] += share
    got = op7.expected_counts(sequences, start, move, emit, most)
    for x, y in zip(got, (starts, moves, out)):
        assert np.allclose(x, y)
    assert got[1].sum() == pytest.approx(sum(len(s) - 1 for s in sequences))
    assert np.allclose(op7.forward_scores(sequences, start, move, emit, most), op7.forward_scores(sequences, start, move, emit))


def plain_scores(sequences, held, sizes, classes, states, rounds):
    """Baum-Welch and forward scores, one text and one step at a time."""
    model = op7.Model(states, np.array([x for x, _ in sizes]), np.array([c for _, c in sizes], float), classes)
    for _ in range(rounds):
        start, move, emit = model.parts()
        starts, moves, out = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
        for seq in (s for s, h in zip(sequences, held) if not h):
            alphas, betas = [start * emit[:, seq[0]]], [np.ones(states)]
            for t in seq[1:]:
                alphas.append(alphas[-1] / alphas[-1].sum() @ move * emit[:, t])
            for t in seq[:0:-1]:
                beta = move @ (emit[:, t] * betas[-1])
                betas.append(beta / beta.sum())
            betas.reverse()
            for i, t in enumerate(seq):
                g = alphas[i] * betas[i]
                out[:, t] += g / g.sum()
                starts += g / g.sum() if i == 0 else 0
                if i:
                    x = alphas[i - 1][:, None] * move * (emit[:, t] * betas[i])
                    moves += x / x.sum()
        model.learn([(-1, list(starts)), *((-2 - i, moves[i]) for i in range(states)), *((c, out[:, c]) for c in np.flatnonzero(out.sum(axis=0)))])
    start, move, emit = model.parts()
    scores = []
    for seq in sequences:
        a, total = start * emit[:, seq[0]], 0.0
        for t in seq[1:]:
            total += math.log10(a.sum())
            a = a / a.sum() @ move * emit[:, t]
        scores.append(total + math.log10(a.sum()))
    return scores


def test_scores_equal_a_plain_model(spark, monkeypatch):
    """The scores of the operator, with words that have a class of their own and words that share one."""
    monkeypatch.setattr(op7, "FREQUENT", 40)
    monkeypatch.setattr(op7, "PIECE", 300)
    rows = corpus(13, 40)
    docs = frame(spark, rows)
    got = {r.doc_id: r.score for r in op7.language_scores(docs, states=3, rounds=2).collect()}
    texts = {d: [*words(lower(t)), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    count = Counter(w for d, t in texts.items() if not held[d] for w in t)
    # the class of each word: read off the rewritten texts, which must agree with each other
    done, sizes, _, _ = op7.classed_documents(docs)
    kind = {}
    for r in done.collect():
        seq = np.frombuffer(r.classes, np.uint16).tolist()
        for w, c in zip(texts[r.doc_id], seq, strict=True):
            assert kind.setdefault(w, c) == c
    own = [w for w, c in kind.items() if c < 40]
    assert len(own) == len({kind[w] for w in own}) == 40
    assert min(count[w] for w in own) >= max(count[w] for w in kind if kind[w] >= 40)
    mass, types = Counter(), Counter()
    for w, n in count.items():
        mass[kind[w]] += n
        types[kind[w]] += 1
    assert dict(sizes) == mass
    order = sorted(texts)
    want = plain_scores([[kind[w] for w in texts[d]] for d in order], [held[d] for d in order], sizes, 40 + op7.SHAPES, 3, 2)
    for d, score in zip(order, want):
        within = sum(math.log10((count[w] + 0.5) / (mass[kind[w]] + 0.5 * (types[kind[w]] + 1))) for w in texts[d] if kind[w] >= 40)
        assert got[d] == pytest.approx(score + within, rel=1e-4)


def test_language_scores(spark):
    rows = corpus(9)
    got = {r.doc_id: r for r in op7.language_scores(frame(spark, rows), states=3, rounds=2).collect()}
    texts = {d: [*words(lower(t)), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = Counter(w for d, t in texts.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    for d, t in texts.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score < 0


def test_words_in_many_chunks_are_broadcast(spark, monkeypatch):
    """The counts come out the same whichever way a word goes."""
    rows = corpus(9, 30)
    docs = frame(spark, rows)
    want = {r.doc_id: (r.n_known, r.base_score) for r in op7.classed_documents(docs)[0].collect()}
    monkeypatch.setattr(op7, "CHUNK", 2000)
    for often in (1 << 20, 600, 1):
        monkeypatch.setattr(blocks, "BROADCAST_ROWS", often)
        got = {r.doc_id: (r.n_known, r.base_score) for r in op7.classed_documents(docs)[0].collect()}
        assert got.keys() == want.keys()
        assert all(got[d] == pytest.approx(want[d]) for d in want)


def test_model_beats_the_unigram_base_on_held_out_texts(spark):
    rows = [r for r in op7.query(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_classes_give_a_distribution():
    emit = op7.Model(4, np.array([0, 5]), np.array([3.0, 2.0]), 10).emit
    assert emit.sum(axis=1) == pytest.approx(np.ones(4))


def test_hilbert_keys_walk_by_single_steps():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = op8.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check_packing(rows, pieces, size=1024):
    ids = dict(zip([d for d, _ in rows], ([*t, 0] for t in tokens([t for _, t in rows]))))
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert by.keys() == ids.keys()
    for d, own in by.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            part = np.array(ids[d][at : at + p.length], "<u4")
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[d]), zlib.crc32(part.tobytes()))
            at += p.length
        assert at == len(ids[d])
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return len(sequences), -(-sum(map(len, ids.values())) // size)


def test_packing_round_trip(spark):
    rows = corpus(10)
    used, least = check_packing(rows, op8.pack(frame(spark, rows)).collect())
    assert used == least


def test_packing_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(op8, "RANGE", 2048)
    rows = corpus(11)
    used, least = check_packing(rows, op8.pack(frame(spark, rows)).collect())
    assert used <= least + 4


def test_histogram(spark):
    rows = [*corpus(12), (None, "a")]
    n = sorted(len(t) for t in tokens([t for _, t in rows]))
    sums = op10.with_suffix_sums(op10.length_histogram(frame(spark, rows)), block=16)
    out = {r.length: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in out.items()} == Counter(n)
    for k, r in out.items():
        assert (r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == (sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n))
        assert (r.n_docs_all, r.n_tokens_all) == (len(n), sum(n)) and r.share_at_most == pytest.approx(sum(x <= k for x in n) / len(n))
    limits = [1, 7, 100, 10**6]
    got = {r.limit: (r.docs_longer, r.tokens_kept, r.tokens_lost) for r in op10.at_limits(sums, limits).collect()}
    assert got == {x: (sum(y > x for y in n), sum(min(y, x) for y in n), sum(max(0, y - x) for y in n)) for x in limits}
    assert {r.share: r.length for r in op10.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: n[math.ceil(len(n) / 2) - 1], 1.0: n[-1]}


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a"), (1, "a"), (2, None)]])
def test_odd_tables(spark, rows):
    docs = frame(spark, rows)
    assert op7.language_scores(docs, states=2, rounds=1).count() == len(rows)
    assert op8.pack(docs).select("doc_id").count() == len(rows)
    assert op10.length_histogram(docs).count() == len({t for _, t in rows})
    assert op4.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ODD = (
    [],
    [(None, None), *((None, " ".join(f"{x}{i}" for i in range(30))) for x in "abcd")],
    [(3, " ".join(f"w{i}" for i in range(40))), (3, " ".join(f"w{i}" for i in range(40))), (4, " ".join(f"w{i}" for i in range(40)) + " x"), (5, ""), (6, None)],
)


@pytest.mark.parametrize("rows", ODD)
def test_pipeline_stages_stand_odd_tables(spark, rows):
    """Empty tables, null and repeated ids, empty texts, ties and columns of clashing names."""
    import corpus_pipeline

    docs = frame(spark, rows)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = blocks.staged(stage(spark, docs, SF), name)
        assert docs.columns == names
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(kept) <= len(rows)
    if rows is ODD[1]:
        assert sorted(t for _, t in kept) == [t for _, t in rows[1:]]
    if rows is ODD[2]:  # rows of one id are one document; the near copy of larger id goes
        assert {d for d, _ in kept} == {3}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(p.length for p in pieces) == sum(len(t) + 1 for t in tokens([t for _, t in kept]))


def test_very_long_texts_and_ties(spark):
    """Whole texts are encoded and scored; documents of one key on the curve are packed one after the other."""
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(1, long), (2, "tie of keys"), (3, "tie of keys"), (4, "tie of keys"), (5, None)]
    check_packing(rows, op8.pack(frame(spark, rows)).collect())
    n = Counter(len(t) for t in tokens([t for _, t in rows]))
    assert {r.length: r.n_docs for r in op10.length_histogram(frame(spark, rows)).collect()} == n
    scores = {r.doc_id: (r.n_tokens, r.score) for r in op7.language_scores(frame(spark, rows), states=2, rounds=1).collect()}
    assert scores[1][0] == 150_001 and all(s < 0 and math.isfinite(s) for _, s in scores.values()) and scores[2] == scores[3] == scores[4]


def test_pipeline(spark):
    import corpus_pipeline
    from fixtures import near_components, removed_words

    from pagewright.llm.blocks import staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()] if "text" in docs.columns else []
        docs = staged(stage(spark, docs, SF), name)
        seen.append(docs.count())
        if name == "near_duplicates":
            want = {d for d, (_, c) in near_components(before, 80, 5).items() if d == c}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "substring_dedup":
            want = removed_words(before, 13)
            assert {r.doc_id for r in docs.collect()} == {d for d, (n, gone, _) in want.items() if gone < n}
            for r in docs.collect():
                assert len(words(r.text)) == want[r.doc_id][0] - want[r.doc_id][1] and r.n_chars == len(r.text)
        if name != "packing":
            assert docs.columns == names
    check_packing(before, docs.collect())
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]
