"""Substring and near-duplicate operators against plain versions."""

import os

import numpy as np
import pyarrow as pa
import pytest
from fixtures import corpus, frame, near_components, removed_bytes, removed_words
from pyspark.sql import functions as F

from pagewright.llm import blocks, op2_suffix_array, op5_suffix_trees, op6_lsh_forest, repeats


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_array_dedup(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_array.suffix_array_dedup(frame(spark, rows)).collect()}
    assert got == removed_bytes(rows, 100)


def test_keys_that_no_task_holds_whole_and_periodic_text(spark, monkeypatch):
    monkeypatch.setattr(repeats.repeated, "__defaults__", (1,))
    monkeypatch.setattr(op5_suffix_trees.suffix_tree_dedup, "__defaults__", (13, 5, 1 << 12, 3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # most repeats are found across batches
    try:
        rows = [*corpus(3, 30), (1000, "ab" * 400), (1001, "x" + "ab" * 90 + "y"), (1002, "a" * 350), (1003, None)]
        docs = frame(spark, rows).repartition(5)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_array.suffix_array_dedup(docs).collect()}
        assert got == removed_bytes(rows, 100)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op5_suffix_trees.suffix_tree_dedup(docs).collect()}
        assert got == removed_words(rows, 13)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("across", [False, True])
def test_rows_of_shared_keys_are_passed_on_in_bounded_memory(across):
    r = np.random.default_rng(1)
    key = np.sort(np.concatenate((np.repeat([3, 9, 12], [400, 2, 1]), r.integers(20, 200, 300))))
    doc = np.concatenate([np.sort(r.integers(0, 5, n)) for n in np.unique(key, return_counts=True)[1]])
    rows = pa.table({"h": key, "doc_id": doc, "pos": np.arange(len(key)), "n": np.ones(len(key), np.int64)})
    got = pa.Table.from_batches(repeats._shared(iter(rows.to_batches(max_chunksize=50)), across, 20)).to_pylist()
    want = [k for k in np.unique(key) if (len(set(doc[key == k])) if across else (key == k).sum()) > 1]
    assert sorted(x["pos"] for x in got) == sorted(np.flatnonzero(np.isin(key, want)).tolist())
    assert {x["h"] for x in got if x["hot"]} == {k for k in want if (key == k).sum() > 20}


def test_judged_windows_by_brute_force():
    r = np.random.default_rng(2)
    for across in (False, True):
        contents = [bytes(r.integers(97, 99, r.integers(3, 9)).astype(np.uint8)) for _ in range(60)]
        doc, pos = r.integers(0, 12, 60), np.arange(60) * 100
        n = np.array([len(c) - 2 for c in contents])
        who, at, m, gone = repeats.judged(contents, doc, pos, n, across, lambda c: op2_suffix_array.equal_windows(c, 3))
        got = {(int(w), int(a) + j): bool(g) for w, a, m_, g in zip(who, at, m, gone) for j in range(m_)}
        where = {(w, o): contents[w][o : o + 3] for w in range(60) for o in range(n[w])}
        assert got.keys() == where.keys()
        for (w, o), s in where.items():
            mine = (doc[w],) if across else (doc[w], pos[w] + o)
            assert got[w, o] == any(t == s and ((doc[v],) if across else (doc[v], pos[v] + p)) < mine for (v, p), t in where.items())


def test_long_texts_are_cut_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 512)
    found = []
    text = b"".join(bytes([97 + (i * i) % 23]) for i in range(5000))
    buf, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    for got, _ in repeats._cut(buf, offsets, "byte", 100, 16):
        found += [x for s, n in zip(got["start"], got["n"]) for x in range(s, s + n)]
    assert sorted(found) == list(range(len(text) - 99))


def test_two_stage_order_is_the_order_of_suffixes():
    r = np.random.default_rng(5)
    for n, k in ((1, 1), (40, 2), (300, 3), (200, 1)):
        text = r.integers(97, 97 + k, n).astype(np.uint8)
        order = op2_suffix_array.two_stage_order(text, n + 1)
        assert sorted(order.tolist()) == list(range(n))
        b = text.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        lcp = op2_suffix_array.common_prefixes(text, order, 7)
        assert lcp[:1].tolist() == [0] * min(1, n)
        for x, y, c in zip(order, order[1:], lcp[1:]):
            s, t = b[x : x + 7].ljust(7, b"\0"), b[y : y + 7].ljust(7, b"\0")
            want = next((i for i in range(7) if s[i] != t[i]), 7)
            assert c == want


@pytest.mark.parametrize("width", [9, 17, 25, 100])
def test_common_prefixes_of_any_width(width):
    text = np.frombuffer(b"ab" * 90, np.uint8)
    order = op2_suffix_array.two_stage_order(text, width)
    for x, y, c in zip(order, order[1:], op2_suffix_array.common_prefixes(text, order, width)[1:]):
        assert c == min(width, len(text) - max(x, y)) if abs(x - y) % 2 == 0 else c == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_tree_dedup(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op5_suffix_trees.suffix_tree_dedup(frame(spark, rows)).collect()}
    assert got == removed_words(rows, 13)


def test_small_prefix_groups_find_the_same():
    contents = [b"a b c d e f", b"x a b c d e", b"b c d e f g"]
    found = [sorted(zip(*op5_suffix_trees.equal_windows(contents, 3, most)[:2])) for most in (1 << 16, 1)]
    assert found[0] == found[1] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]


def test_subtrees_have_the_common_prefixes_of_sorted_suffixes():
    words = np.random.default_rng(3).integers(0, 3, 300)
    start = np.arange(290)
    for group, depth in op5_suffix_trees.prefix_groups(words, start, 9, 40):
        leaves, lcp = op5_suffix_trees.subtree(words, group, depth, 9)
        rows = [tuple(words[x : x + 9]) for x in leaves]
        assert rows == sorted(rows) and len({x[:depth] for x in rows}) == 1 and (len(group) <= 40 or depth == 9)
        assert [next((j for j in range(9) if a[j] != b[j]), 9) for a, b in zip(rows, rows[1:])] == lcp[1:].tolist()


def test_prefixes_grow_until_groups_are_small(spark):
    rows = [(1, 0, " ".join("ab"[int(x)] for x in np.random.default_rng(4).integers(0, 2, 400)).encode())]
    table = spark.createDataFrame(rows, "doc_id long, pos long, content binary")
    crowded = op5_suffix_trees.prefixes(table, 6, 30)
    assert [len(x) for x in crowded][:3] == [2, 4, 8]
    out = table.mapInArrow(lambda it: op5_suffix_trees._suffixes(it, 6, crowded, 1 << 40), "bin long, n long, block binary")
    sizes = [r["n"] for r in out.groupBy("bin").agg({"n": "sum"}).toDF("bin", "n").collect()]
    assert sum(sizes) == 395 and max(sizes) <= 30


def test_without_repeats_keeps_white_space_and_columns(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a\n{passage}\tb"), (2, f"c  d\n{passage} e"), (3, passage), (4, None), (None, passage)]
    docs = frame(spark, rows)
    out = op5_suffix_trees.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars, r.kept) for r in out.collect()}
    assert got == {1: (rows[0][1], len(rows[0][1]), "x"), 2: ("c  d\ne", 6, "x"), 4: ("", 0, "x"), None: (passage, len(passage), "x")}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rows = corpus(seed)
    out = op6_lsh_forest.near_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == near_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_dedup_of_crowded_regions(spark, monkeypatch):
    """All regions are crowded, so all comparisons across components are made by rare shingles."""
    monkeypatch.setattr(op6_lsh_forest, "DENSE", 1)
    rows = corpus(4, 80)
    out = op6_lsh_forest.near_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == near_components(rows)


def test_links_that_only_the_second_search_finds(spark, monkeypatch):
    """Without any candidate from neighbours, comparing across components finds every link."""
    monkeypatch.setattr(op6_lsh_forest, "near_pairs", lambda forest, depth: spark.createDataFrame([], "a long, b long"))
    rows = corpus(6, 60)
    for dense in (32, 2):
        monkeypatch.setattr(op6_lsh_forest, "DENSE", dense)
        out = op6_lsh_forest.near_dedup(frame(spark, rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == near_components(rows)


def test_near_dedup_of_five_words(spark):
    rows = corpus(5)
    out = op6_lsh_forest.near_dedup(frame(spark, rows), k=5, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == near_components(rows, 80, 5)
    assert len(op6_lsh_forest.orders(85)) == 20 and len(op6_lsh_forest.orders(80)) == 28


def test_near_dedup_of_ids_with_several_texts(spark):
    """Rows of one id are one document, in whatever order they come."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (7, a + " z"), (7, b), (8, b), (9, c), (4, c + " y"), (4, c)]
    want = {5: 5, 7: 5, 8: 5, 9: 4, 4: 4}
    for order in (rows, rows[::-1]):
        out = op6_lsh_forest.near_dedup(frame(spark, order)).collect()
        assert len(out) == 7 and all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id in (4, 5)) for r in out)


def templated(n, words, own, seed, scattered=False):
    """Documents of one template, each with own words, in one place or scattered; similarities lie about the limit."""
    r = np.random.default_rng(seed)
    base, rows = [f"t{i}" for i in range(words)], []
    for i in range(n):
        mine = [f"d{i}w{j}" for j in range(r.integers(*own))]
        w = list(base)
        if scattered:
            for at, x in zip(sorted(r.integers(0, words, len(mine)), reverse=True), mine):
                w.insert(at, x)
        else:
            at = int(r.integers(0, words))
            w[at:at] = mine
        rows.append((i * 2 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize(("words", "own", "scattered"), [(300, (15, 45), False), (400, (5, 30), True), (1500, (90, 200), False)])
def test_near_dedup_of_one_template(spark, words, own, scattered):
    """Crowded regions with some links and many pairs just below the limit; the last has more than a thousand shingles a text."""
    rows = templated(120, words, own, 3, scattered) + [(1000 + d, t) for d, t in templated(60, words, (own[1], 2 * own[1]), 4, scattered)]
    out = op6_lsh_forest.near_dedup(frame(spark, rows)).collect()
    want = near_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert 10 < len({c for _, c in want.values()}) < 170


def test_first_shingles_miss_no_link(spark, monkeypatch):
    """Of any two similar sets of different components, the index alone makes a pair, in whatever parts its rows are looked up."""
    monkeypatch.setattr(op6_lsh_forest, "PART", 7)
    r = np.random.default_rng(9)
    base = r.integers(0, 10**6, 200)
    sets = []
    for i in range(60):
        own = base[r.random(200) > r.choice([0.0, 0.03, 0.08, 0.12])]
        sets.append(np.unique(np.concatenate((own, r.integers(10**6, 2 * 10**6, r.integers(0, 25))))))
    c = [i // 2 if i < 20 else i for i in range(60)]
    table = spark.createDataFrame([(i, c[i], len(x), i, x.tolist()) for i, x in enumerate(sets)], "rep long, c long, n long, key long, hashes array<long>")
    size = spark.createDataFrame([(i, len(x), 0, 0, 0, 0) for i, x in enumerate(sets)], "rep long, n_shingles long, bits0 long, bits1 long, bits2 long, bits3 long")
    index = op6_lsh_forest._indexed(table, size, 85)
    made = {tuple(p) for p in op6_lsh_forest._across(index, 85).collect()}
    links = set()
    for i in range(60):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if c[i] != c[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                links.add((j, i))
    assert links <= made and 50 < len(links) and len(made) < 1770
    assert {tuple(p) for p in op6_lsh_forest._similar(spark.createDataFrame(sorted(made), "a long, b long"), table, 85).collect()} == links


def test_heavy_documents_make_no_pairs(spark):
    """Documents of one template that are all too unlike each other are told apart before any pair is made."""
    sets = [[*range(1000), *range(10_000 * (i + 1), 10_000 * (i + 1) + 120)] for i in range(50)]
    table = spark.createDataFrame([(i, i, 1120, i, x) for i, x in enumerate(sets)], "rep long, c long, n long, key long, hashes array<long>")
    size = spark.createDataFrame([(i, 1120, 0, 0, 0, 0) for i in range(50)], "rep long, n_shingles long, bits0 long, bits1 long, bits2 long, bits3 long")
    index = op6_lsh_forest._indexed(table, size, 85)
    bound = (F.col("n_shingles") - F.col("place")) * 185 - F.col("n_shingles") * 85
    assert index.count() == 50 * (1120 - 952 + 1 - 120) and index.where(bound >= F.col("n_shingles") * 85).isEmpty()
    assert op6_lsh_forest._across(index, 85).isEmpty()


def test_neighbours_of_sorted_orders():
    r = np.random.default_rng(8)
    paths = np.concatenate((np.zeros((60, 1), int), r.integers(0, 2, (60, 4))), axis=1)
    paths = paths[np.lexsort(paths.T[::-1])]
    rep = r.permutation(60)
    rows = pa.RecordBatch.from_arrays([op6_lsh_forest._binary(paths.astype(">u2"), 10), pa.array(rep)], names=["path", "rep"])
    for size in (60, 7):
        got = pa.Table.from_batches(op6_lsh_forest._neighbours((rows.slice(i, size) for i in range(0, 60, size)), 2)).to_pylist()
        rows_ = [x for x in got if x["head"] is None]
        near = {(x["a"], x["b"], x["shared"]) for x in rows_ if x["shared"] is not None}
        want = set()
        for i in range(1, 60):
            lcp = next((j for j in range(4) if paths[i, j + 1] != paths[i - 1, j + 1]), 4)
            if lcp >= 2:
                want |= {(rep[i], rep[i - 1], lcp), (rep[i - 1], rep[i], lcp)}
        assert near == want
        # the least documents and the links between pieces connect each region, and nothing else
        root = {x: x for x in rep}
        find = lambda x: x if root[x] == x else find(root[x])
        for x in rows_:
            if x["shared"] is None:
                root[max(find(x["a"]), find(x["b"]))] = min(find(x["a"]), find(x["b"]))
        for i in range(60):
            assert find(rep[i]) == min(rep[j] for j in range(60) if (paths[j, :3] == paths[i, :3]).all())
        assert len([x for x in got if x["head"] is not None]) == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in op6_lsh_forest.components(links, "chain").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c d e f g h i j k l m n"), (None, None)], [(5, "same words again " * 9), (5, "same words again " * 9)]])
def test_odd_tables(spark, rows):
    docs = frame(spark, rows)
    for out in (op2_suffix_array.suffix_array_dedup(docs), op5_suffix_trees.suffix_tree_dedup(docs), op6_lsh_forest.near_dedup(docs)):
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(d) for d, _ in rows)
    if rows and rows[0][0] == 5:
        assert all(r.n_removed == 0 for r in op5_suffix_trees.suffix_tree_dedup(docs).collect())


def test_staged_uses_the_shared_folder(spark):
    df = blocks.staged(spark.range(3).toDF("x"), "probe")
    assert df.inputFiles()[0].startswith("file:") and "/checkpoints/probe-" in df.inputFiles()[0]
    assert df.count() == 3


def test_staged_tables_can_be_discarded_and_need_a_shared_folder(spark, monkeypatch):
    df = blocks.staged(spark.range(3).toDF("x"), "probe")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    blocks.discarded(df)
    assert not os.path.exists(folder)

    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        blocks.shared_folder(Session())
    Session.conf |= {"spark.master": "local[2]", "spark.sql.warehouse.dir": "/w"}
    assert blocks.shared_folder(Session()) == "/w/staging"
