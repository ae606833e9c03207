"""Words by their places, histories with branches, and keyed states of a stream against plain versions."""

import random

import regex
from pyspark.sql import functions as F

from pagewright.functions import tokens
from pagewright.operators import history
from pagewright.operators.lifecycle import append_events
from pagewright.streaming import activity

TEXTS = ["", " ", "  \n ", "a", "ab cd", "ab,, cd", "  ab", "ab  ", "дом é_1 -- x2!", "a  b", "a b", "x" * 50, "ab ab xab abx ab, ab", "...", "\U0001f600\U0001f600 a", "é é"]


def kind_of(ch):
    return "space" if regex.match(r"[\s﻿]", ch) else "word" if regex.match(r"[\p{L}\p{N}\p{M}_]", ch) else "punct"


def plain_token(text, offset):
    if not text.strip(" \n 　﻿"):
        return None
    i = max(0, min(offset, len(text) - 1))
    if kind_of(text[i]) == "space":
        near = [j for j in range(len(text)) if kind_of(text[j]) != "space"]
        i = min(near, key=lambda j: (abs(j - i), j))
    a = b = i
    while a and kind_of(text[a - 1]) == kind_of(text[i]):
        a -= 1
    while b + 1 < len(text) and kind_of(text[b + 1]) == kind_of(text[i]):
        b += 1
    return a, b + 1, text[a : b + 1], kind_of(text[i])


def test_tokens_at_all_offsets(spark):
    rows = [(t, o) for t in TEXTS for o in range(-2, min(len(t), 30) + 3)]
    got = spark.createDataFrame(rows, "t string, o int").select("t", "o", tokens.token_at(F.col("t"), F.col("o")).alias("x"), tokens.line_at(F.col("t"), F.col("o")).alias("line")).collect()
    for r in got:
        assert (None if r.x is None else tuple(r.x)) == plain_token(r.t, r.o), (r.t, r.o)
        assert r.line == r.t[: max(0, r.o)].count("\n")
    assert spark.createDataFrame([(None, 3)], "t string, o int").select(tokens.token_at(F.col("t"), F.col("o"))).first()[0] is None


def test_offsets_of_lines(spark):
    rows = [(t, n) for t in ("", "a", "a\nb\n", "\n\n", "ab\ncd\nef") for n in range(-1, 5)]
    for t, n, got in spark.createDataFrame(rows, "t string, n int").select("t", "n", tokens.offset_of_line(F.col("t"), F.col("n"))).collect():
        starts = [0, *(i + 1 for i, c in enumerate(t) if c == "\n")]
        assert got == (0 if n <= 0 else starts[n] if n < len(starts) else len(t))


def plain_nearest(text, token, offset, whole):
    free = lambda i, e: not whole or not (i and kind_of(text[i - 1]) == "word") and not (e < len(text) and kind_of(text[e]) == "word")
    places = [i for i in range(len(text) - len(token) + 1) if token and text[i : i + len(token)] == token and free(i, i + len(token))]
    return min(places, key=lambda i: (abs(i - offset), i), default=None)


def test_nearest_places(spark):
    r = random.Random(4)
    texts = [t for t in TEXTS if len(t) < 40] + ["".join(r.choice("ab ,é") for _ in range(r.randint(1, 40))) for _ in range(60)]
    rows = [(t, k, o, w) for t in texts for k in ("a", "ab", "aa", ",", "", "b a") for o in (-3, 0, 5, 17, 99) for w in (True, False)]
    df = spark.createDataFrame(rows, "t string, k string, o int, w boolean")
    for t, k, o, w, got, by_index in df.select("t", "k", "o", "w", tokens.nearest_place("t", "k", "o", "w"), tokens.nearest_word(tokens.word_places("t"), F.col("k"), F.col("o"))).collect():
        assert got == plain_nearest(t, k, o, w), (t, k, o, w)
        if w and k and all(kind_of(c) == "word" for c in k):
            assert by_index == got


def plain_history(steps, most):
    """The rule as two stacks: what lies behind, with the page one is at, and what lies ahead."""
    behind, ahead = [], []
    for kind, page in steps:
        if kind == "back":
            if len(behind) > 1:
                ahead.append(behind.pop())
        elif kind == "forward":
            if ahead:
                behind.append(ahead.pop())
        elif page and page > 0 and (not behind or behind[-1] != page):
            behind, ahead = (behind + [page])[-most:], []
    return behind + ahead[::-1], len(behind) - 1


def some_steps(n=900, users=7):
    r = random.Random(6)
    return [(r.randrange(users) if r.random() < 0.97 else None, i, r.choice(["visit", "visit", "visit", "back", "forward"]), r.choice([None, 0, -1, *range(1, 30)])) for i in range(n)]


STEPS = "user long, at long, kind string, page long"


def test_histories_equal_two_stacks(spark):
    rows = some_steps()
    want = {u: plain_history([(k, p) for v, _, k, p in rows if v == u], 12) for u in range(7)}
    got = history.histories(spark.createDataFrame(rows, STEPS).repartition(5), most=12).collect()
    assert {r.user: (r.history, r.place) for r in got} == want and len(got) == 7
    assert history.histories(spark.createDataFrame([], STEPS)).collect() == []


def test_a_visit_after_going_back_cuts_the_branch_and_stream_equals_batch(spark, tmp_path):
    rows = some_steps(400, 4) + [(50, 1000, "visit", 1), (50, 1001, "visit", 2), (50, 1002, "visit", 3), (50, 1003, "back", None), (50, 1004, "back", None), (50, 1005, "visit", 9)]
    folder = str(tmp_path / "steps")
    for lo in range(0, len(rows), 140):  # a file a batch
        spark.createDataFrame(rows[lo : lo + 140], STEPS).coalesce(1).write.mode("append").parquet(folder)
        stream = history.history_stream(spark.readStream.schema(STEPS).parquet(folder), most=10)
        # each run is a restart from the checkpoint
        last = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        last.awaitTermination()
    want = {r.user: (r.history, r.place) for r in history.histories(spark.createDataFrame(rows, STEPS), most=10).collect()}
    assert want[50] == ([1, 9], 1)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.user, []).append((r.history, r.place))
    assert all(want[u] in states for u, states in got.items()) and got.keys() == want.keys()


def test_pages_beside_and_allowed_pages(spark):
    rows = [([1, 2, 3, 4], 2, [2, 4]), ([1, 2, 3], 0, [3]), ([1, 2], 1, []), ([], -1, [1]), ([5, 6, 5], 2, [5])]
    df = spark.createDataFrame(rows, "h array<long>, p int, ok array<long>")
    got = [(r.a, r.b, r.f.history, r.f.place) for r in df.select(history.neighbour(F.col("h"), F.col("p"), -1).alias("a"), history.neighbour(F.col("h"), F.col("p"), 1).alias("b"), history.allowed_only(F.col("h"), F.col("p"), F.col("ok")).alias("f")).collect()]
    assert got == [(2, 4, [2, 4], 0), (None, 2, [3], 0), (1, None, [], -1), (None, None, [], -1), (6, None, [5, 5], 1)]


def test_states_of_pages_survive_restarts_repeats_and_a_new_log(spark, tmp_path):
    schema = activity.SCHEMA
    row = lambda i, page, kind, stage="ocr_extract": (i, None, page, stage, kind, False, "m")
    batches = [
        [row(5, 1, "job_started"), row(6, 2, "job_started"), row(7, 2, "job_completed"), row(8, 3, "job_started", "layout_benchmark")],
        [row(7, 2, "job_completed"), row(6, 2, "job_started"), row(5, 1, "job_started")],  # again, nothing new
        [row(9, 1, "job_failed"), row(10, 1, "job_failed", "layout_benchmark")],
        [row(1, 1, "job_started"), row(2, 2, "job_failed")],  # a log that was begun anew
        [row(3, 1, "job_completed"), row(0, 2, "job_started"), row(4, -1, "job_started")],
    ]
    seen = []
    for rows in batches:
        append_events(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "log"))
        out = activity.applied_states(activity.event_stream(spark, str(tmp_path / "log")))
        got = []
        q = out.writeStream.outputMode("update").foreachBatch(lambda b, _, got=got: got.extend((r.page_id, r.id, r.status) for r in b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(sorted(got))
    assert [[(p, i) for p, i, _ in x] for x in seen] == [[(1, 5), (2, 7)], [], [(1, 10)], [(1, 1), (2, 2)], [(1, 3)]]
    assert seen[0][0][2] != seen[2][0][2] and seen[0][0][2] == seen[3][0][2] and seen[0][1][2] == seen[4][0][2]
