"""License scan, decontamination and quality rules against plain versions."""

import re

import pytest
from fixtures import corpus, frame, words

from pagewright.llm import containment, op1_license_scan, op3_quality_rules, op9_decontamination  # noqa: F401


def alnum(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def matches(docs, items, percent=80):
    out = set()
    for d, t in docs:
        w = alnum(t)
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for k, s in items:
            v = alnum(s)
            want = {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
            if want and 100 * len(have & want) >= percent * len(want):
                out.add((d, k))
    return out


def test_items_are_found_in_long_texts(spark):
    rows = corpus(7, 40)
    items = [(i, " ".join(f"item{i}w{j}" for j in range(n))) for i, n in enumerate((5, 8, 15, 16, 40, 57))] + [(90, "too short"), (91, None)]
    hidden = []
    for d, (i, s) in zip(range(1000, 1100), items[:6] * 2):
        hidden.append((d, f"{rows[-1][1]} {s.upper() if d % 2 else s.replace(' ', ', ')} {rows[-2][1]}"))
    half = (2000, " ".join(items[4][1].split()[:20]))
    docs = [*rows, *hidden, half]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = containment.contained(frame(spark, docs).select("doc_id", "text"), table)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == matches(docs, items)
    assert len(matches(docs, items)) == 12


def test_shuffled_vocabulary_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(containment, "bounded", lambda df, rows=0: df)
    items = [(1, " ".join(f"w{j}" for j in range(30)))]
    docs = [(1, "a b c " + items[0][1]), (2, "nothing of it here at all")]
    got = containment.contained(frame(spark, docs).select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.doc_id, r.n_shingles, r.n_found, r.first_word) for r in got.collect()] == [(1, 26, 26, 3)]


@pytest.mark.parametrize("n, inserted", [(31, (10, 20, 60)), (63, (30, 60, 200))])
def test_items_with_inserted_words_are_found_at_every_offset(spark, n, inserted):
    item = [f"w{j}" for j in range(n + 4)]
    cuts = [(len(item) // 2, m) for m in inserted] + [(len(item) // 3, inserted[0])]
    texts = [" ".join([*(f"a{j}" for j in range(offset)), *item[:cut], *(f"b{j}" for j in range(m)), *item[cut:]]) for cut, m in cuts for offset in range(0, 2 * n + 2)]
    got = containment.contained(frame(spark, list(enumerate(texts))).select("doc_id", "text"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {(r.doc_id, r.n_shingles, r.n_found) for r in got.collect()} == {(d, n, n - 4) for d in range(len(texts))}


def test_scattered_shared_and_null_ids_match_whole_texts(spark):
    shared = [f"s{j}" for j in range(20)]
    items = [(i, " ".join([*shared, *(f"i{i}w{j}" for j in range(i))])) for i in (3, 9, 20)] + [(None, " ".join(f"n{j}" for j in range(12)))]
    parts = [" ".join(items[2][1].split()[a : a + 14]) for a in range(0, 40, 10)]
    docs = [(1, (" " + "x " * 90).join(parts)), (2, " ".join(shared)), (None, items[3][1]), (4, " ".join(t for _, t in items))]
    got = containment.contained(frame(spark, docs).select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string"))
    want = matches(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and {(1, 20), (2, 3), (None, None), (4, 9)} <= want


def test_license_notices(spark):
    docs = [(1, "x\nLicensed under the Apache License, Version 2.0."), (2, "released UNDER the mit license"), (3, "no license"), (4, None), (5, "Licensed under the Apache")]
    got = {(r.doc_id, r.license) for r in op1_license_scan.license_scan(frame(spark, docs)).collect()}
    assert got == {(1, "Apache-2.0"), (2, "MIT")}


def test_whole_license_texts_with_words_put_in(spark):
    whole = dict((i, t) for i, _, t in op1_license_scan.TEMPLATES)
    docs = [(1, "Copyright 2020 somebody\n" + whole[15]), (2, "# " + whole[16].replace("COPYRIGHT HOLDER", "REGENTS").replace(". ", ".\n# ")), (3, whole[18] + " more"), (4, whole[15][: len(whole[15]) // 2])]
    got = {(r.doc_id, r.template_id) for r in op1_license_scan.license_scan(frame(spark, docs)).collect()}
    assert {(1, 15), (1, 5), (2, 9), (2, 16), (3, 18)} <= got and not {(4, 15), (2, 15)} & got


def test_licenses_that_share_much_of_their_text(spark):
    """Two licences of which one has a clause more hold each other by 80 per cent; what is found of them tells which it is."""
    whole = {i: t for i, _, t in op1_license_scan.TEMPLATES}
    docs = [(16, whole[16]), (23, whole[23].replace("COPYRIGHT HOLDER ", "REGENTS ")), (24, "Copyright (C) 2020 by someone\n" + whole[24]), (29, "2. Grant. " + whole[29] + " 3. Patents."), (30, "Preamble\n" + whole[30])]
    got = {(r.doc_id, r.template_id): r.n_found / r.n_shingles for r in op1_license_scan.license_scan(frame(spark, docs)).collect()}
    assert {(d, d) for d, _ in docs} <= got.keys() and all(got[d, d] > 0.9 for d, _ in docs)
    assert got[16, 16] == 1.0 and 0.8 <= got[16, 23] < 0.95 and got[23, 16] > 0.9


def test_first_word_is_the_item_s_own(spark):
    """Shingles of another item in the same window do not move the place."""
    items = [(1, "a b c d e f g h"), (2, "p q r s t u v w")]
    docs = [(1, "p q r s t z a b c d e f g h"), (2, "x x x p q r s t u v w"), (3, "a b c d e " + "x " * 40 + "a b c d e f g h")]
    got = containment.contained(frame(spark, docs).select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.first_word) for r in got} == {(1, 1, 6), (2, 2, 3), (3, 1, 45)}


def test_items_of_few_words_are_found_as_they_stand(spark):
    items = [(1, "Yes"), (2, "to be"), (3, "one two three four"), (4, "one two three four five"), (5, "..."), (6, "東京は日本の首都である")]
    docs = [(1, "yes, to be: one-two three! four"), (2, "be to"), (3, "one two three four five"), (4, "「東京は日本の首都である」"), (5, None), (None, "well, yes")]
    got = containment.contained(frame(spark, docs).select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_found, r.first_word) for r in got} == {(1, 1, 1, 0), (1, 2, 1, 1), (1, 3, 1, 3), (3, 3, 1, 0), (3, 4, 1, 0), (4, 6, 1, 0), (None, 1, 1, 1)}


def test_recall_of_items_with_repeated_shingles(spark):
    """Every match by whole-text containment is found, also of items that say the same thing several times."""
    import random

    r = random.Random(3)
    items = []
    for i in range(40):
        part = [r.choice("abcdefghij") + str(r.randint(0, 3)) for _ in range(r.randint(4, 12))]
        items.append((i, " ".join(part * r.randint(1, 4) + [f"w{i}"] * r.randint(0, 2))))
    docs = []
    for d in range(300):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 3)):
            w.insert(r.randrange(len(w) + 1), "x")
        docs.append((d, " ".join(["y"] * r.randint(0, 30) + w + ["z"] * r.randint(0, 9))))
    got = {(x.doc_id, x.item_id) for x in containment.contained(frame(spark, docs).select("doc_id", "text"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, i in matches(docs, items)}
    assert want and {(d, i) for d, i in got if len(alnum(items[i][1])) >= 5} == want


@pytest.mark.parametrize("items", [[], [(1, None), (None, ""), (2, " .. ")]])
def test_empty_items_and_documents(spark, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    for docs in ([], [(1, None), (None, ""), (2, "some words that are here for once")]):
        assert containment.contained(frame(spark, docs).select("doc_id", "text"), table).count() == 0


def base(text):
    w = words(text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_measures(spark):
    rows = [*corpus(5), (5000, "#a |b\n#a |b\n\n \n*$%&<>"), (5001, "a b c d e f g h a b c d e f g h i")]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in op3_quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert got == {d: base(t) for d, t in rows}


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [("bad", "short")] * 30 + [("bad", good)] * 2 + [("good", good)] * 30 + [("good", "short")] + [("tiny", "short")]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = op3_quality_rules.quality_rules(docs).collect()
    assert {r.host for r in out if r.host_rejected} >= {"bad"} and "good" not in {r.host for r in out if r.host_rejected}
    assert not any(r.kept for r in out if r.host == "bad") and sum(r.kept for r in out if r.host == "good") == 30
    rates = {r.host: r.rate for r in op3_quality_rules.host_rates(docs.selectExpr("source as host", "length(text) < 9 as failed")).collect()}
    assert 32 / 34 < 1 and rates["bad"] < 30 / 32 + 0.02 and rates["tiny"] < 1
    assert op3_quality_rules.passing(docs).count() == 30


def test_the_stage_fails_symbols_and_repeated_lines(spark):
    good = "\n".join(" ".join(f"w{i}" for i in range(j, j + 6)) for j in range(0, 60, 6))
    symbols = " ".join(f"word{i} #$%" for i in range(40))
    lines = "\n".join(f"a{i} b{i} c{i} d{i} e{i} f{i} g{i}\nx" for i in range(10))
    docs = spark.createDataFrame([(1, good, "a"), (2, symbols, "a"), (3, lines, "a"), (4, good, "b"), *((i, symbols, "b") for i in range(10, 40))], "doc_id long, text string, source string")
    docs = docs.union(spark.createDataFrame([(i, good, "a") for i in range(100, 130)], docs.schema))
    assert not any(r.base_failed for r in op3_quality_rules.quality_rules(docs).collect())
    assert {r.doc_id for r in op3_quality_rules.passing(docs).collect()} == {r.doc_id for r in op3_quality_rules.quality_rules(docs).where("kept").collect()} == {1, *range(100, 130)}


def test_the_stage_keeps_documents_labelled_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    base = op3_quality_rules.quality_rules(docs).where("not base_failed").select("doc_id").join(labels, "doc_id")
    stage = op3_quality_rules.passing(docs).select("doc_id").join(labels, "doc_id")
    n = lambda rows, quality: rows.where(f"quality = {quality}").count()
    assert n(stage, 1) == n(base, 1) and n(stage, 0) < n(base, 0)


def test_passing_keeps_clashing_columns(spark):
    docs = frame(spark, corpus(6, 20)).withColumnRenamed("block", "host").withColumnRenamed("word", "w")
    out = op3_quality_rules.passing(docs)
    assert out.columns == docs.columns and out.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, ""), (1, "")]])
def test_odd_tables(spark, rows):
    docs = frame(spark, rows)
    assert op3_quality_rules.quality_rules(docs).count() == len(rows) and op3_quality_rules.passing(docs).count() == 0
    assert op1_license_scan.license_scan(docs).count() == 0


def test_very_long_texts_and_repeated_rows(spark):
    """Whole texts are measured and searched, and rows of one id are judged row by row."""
    item = " ".join(f"item{j}" for j in range(20))
    long = " ".join(f"w{i}" for i in range(200_000)) + " " + item
    rows = [(1, long), (1, long), (2, "#" * 1_000_000), (None, long)]
    out = op3_quality_rules.quality_rules(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_symbols, r.kept) for r in out) == [("1", 200_020, 0, True)] * 2 + [("2", 1, 1_000_000, False), ("None", 200_020, 0, True)]
    table = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = containment.contained(frame(spark, rows).select("doc_id", "text"), table).collect()
    assert sorted((str(r.doc_id), r.n_found, r.first_word) for r in got) == [("1", 16, 200_000), ("None", 16, 200_000)]
