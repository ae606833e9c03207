"""State that outlives workers and runs: keys and crops, merged tables, and inventories of files."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.operators import rounds
from pagewright.sources import inventory, tables
from pagewright.sources.tables import loaded_json, saved_json


def provider(folder):
    """Calls that leave a file each: k1 is used up for the day, k2 refuses odd crops, any key fails crops of five."""

    def make():
        import uuid

        def call(key, prompt):
            n = int(prompt.split()[-1])
            open(f"{folder}/{key}-{n}-{uuid.uuid4().hex}", "w").close()
            if key == "k1":
                raise RuntimeError("429: quota exceeded, limit per day")
            if n % 5 == 0:
                raise RuntimeError("500 internal")
            if key == "k2" and n % 2:
                raise RuntimeError("429 resource exhausted")
            return f"{key}:{n}"

        return call

    return make


def calls(folder):
    return sorted(tuple(x.split("-")[:2]) for x in os.listdir(folder))


def test_an_exhausted_key_is_used_by_no_later_call(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    crops = spark.createDataFrame([(i, f"crop {i}") for i in range(1, 60)] + [(100, ""), (101, None)], "layout_id long, prompt string").repartition(7)
    out = rounds.extracted(crops, provider(str(log)), ["k1", "k2", "k3", "k2"], str(tmp_path / "state"))
    got = {r.layout_id: r for r in out.collect()}
    assert len(got) == 61 and got[100].state == got[101].state == "skipped"
    for n in range(1, 60):
        want = ("failed", None) if n % 5 == 0 else ("extracted", f"{got[n].used_key}:{n}")
        assert (got[n].state, got[n].raw) == want and got[n].used_key in (("k3",) if n % 2 and n % 5 else ("k2", "k3", None))
    made = calls(log)
    # found exhausted by one call in the whole run: no worker and no round uses it again
    assert sum(k == "k1" for k, _ in made) == 1 and loaded_json(spark, f"{tmp_path}/state/exhausted") == ["k1"]
    assert all(sum(n == str(m) for k, n in made if k != "k1") == 2 for m in range(5, 60, 5))
    row = rounds.counters(out).first()
    assert (row.extracted, row.skipped, row.failed, row.requests) == (48, 2, 11, 48)
    # a run that has ended makes no call
    rounds.extracted(crops, provider(str(log)), ["k1", "k2", "k3"], str(tmp_path / "state"))
    assert calls(log) == made


def test_a_run_goes_on_after_its_last_round_and_tries_the_pool_once_more(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    crops = spark.createDataFrame([(i, f"crop {i}") for i in (1, 2, 3)], "layout_id long, prompt string")
    state = str(tmp_path / "state")
    saved_json(spark, f"{state}/exhausted", ["k1", "k3"])
    out = {r.layout_id: r for r in rounds.extracted(crops, provider(str(log)), ["k1", "k3"], state).collect()}
    # both were used up; tried again, k3 works
    assert all(out[i].raw == f"k3:{i}" for i in (1, 2, 3)) and loaded_json(spark, f"{state}/progress")["revalidated"]
    # a run of which only the first table was written
    other = str(tmp_path / "other")
    rounds.extracted(crops, provider(str(log)), ["k3"], other)
    saved_json(spark, f"{other}/progress", {"round": 0, "revalidated": False})
    before = len(calls(log))
    assert rounds.extracted(crops, provider(str(log)), ["k3"], other).count() == 3 and len(calls(log)) == before + 3
    none = rounds.extracted(crops, provider(str(log)), [], str(tmp_path / "none")).collect()
    assert {(r.state, r.error) for r in none} == {("failed", "no usable key")}
    assert rounds.extracted(crops.limit(0), provider(str(log)), ["k3"], str(tmp_path / "empty")).collect() == []


def test_crops_of_a_key_are_called_from_many_tasks(spark, tmp_path):
    def make():
        from pyspark import TaskContext

        return lambda key, prompt: f"{TaskContext.get().partitionId()}"

    crops = spark.range(1, 400, 1, 4).select(F.col("id").alias("layout_id"), F.concat(F.lit("crop "), F.col("id").cast("string")).alias("prompt"))
    state = str(tmp_path / "state")
    out = rounds.extracted(crops.unionByName(crops.where("layout_id <= 2")), make, ["k"], state).collect()
    # copies of an id are crops of their own
    assert len(out) == 401 and {r.state for r in out} == {"extracted"} and max(Counter(r.raw for r in out).values()) < 300
    # closed crops are in one round
    assert spark.read.parquet(f"{state}/round=1").where("state <> 'open'").count() == 401 and loaded_json(spark, f"{state}/progress")["round"] == 1


def test_merges_write_the_touched_buckets_alone(spark, tmp_path):
    path, r, want = str(tmp_path / "t"), random.Random(3), {}
    schema = "page long, model string, score double, at long"
    for version in range(5):
        keys = [(r.randrange(400), r.choice("ab")) for _ in range(500 if not version else 10)]
        rows = [(p, m, r.random(), version * 1000 + i) for i, (p, m) in enumerate(keys)]
        want |= {(p, m): s for p, m, s, _ in rows}
        batch = spark.createDataFrame(rows, schema)
        n = tables.merged(spark, path, batch, ["page", "model"], version, order="at", buckets=32)
        assert n <= (32 if not version else 10)
        assert len(os.listdir(f"{path}/data/v={version}")) <= n + 2  # buckets, a mark of success and its sum
        assert {(x.page, x.model): x.score for x in tables.table(spark, path).collect()} == want
    # merged again, as after a failure, nothing changes
    tables.merged(spark, path, batch, ["page", "model"], 4, order="at")
    assert {(x.page, x.model): x.score for x in tables.table(spark, path).collect()} == want
    assert tables.merged(spark, path, batch.limit(0), ["page", "model"], 5) == 0 and tables.table(spark, path).count() == len(want)
    with pytest.raises(ValueError):
        tables.table(spark, str(tmp_path / "nowhere"))


def test_a_stream_is_merged(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    for rows in ([(1, 1.0), (2, 2.0)], [(2, 3.0), (3, 4.0)], [(1, 9.0)]):
        spark.createDataFrame(rows, "k long, v double").coalesce(1).write.mode("append").parquet(source)
        tables.merge_stream(spark.readStream.schema("k long, v double").parquet(source), path, ["k"], str(tmp_path / "check")).awaitTermination()
    assert {(x.k, x.v) for x in tables.table(spark, path).collect()} == {(1, 9.0), (2, 3.0), (3, 4.0)}


def test_a_second_scan_reads_changed_files_alone(spark, tmp_path, monkeypatch):
    root = tmp_path / "pages"
    (root / "a b").mkdir(parents=True)
    for i in range(6):
        (root / ("a b" if i % 2 else ".") / f"{i}.png").write_bytes(b"x%d" % i)
    (root / "note.txt").write_text("no page")
    none = spark.createDataFrame([], "rel_path string, length long, modified timestamp, file_hash string")
    record = lambda df: spark.createDataFrame(df.collect(), df.schema)
    first, n = inventory.rescan(spark, str(root), none)
    first = record(first)
    assert n == 6 and {(r.rel_path, r.file_hash) for r in first.collect()} == {tuple(r) for r in inventory.scan(spark, str(root)).collect()}
    same, n = inventory.rescan(spark, str(root), first)
    assert n == 0 and sorted(same.collect()) == sorted(first.collect())
    (root / "2.png").write_bytes(b"other")
    (root / "0.png").unlink()
    (root / "new.jpg").write_bytes(b"y")
    for most in (10, 1):
        monkeypatch.setattr(inventory, "MOST_NAMED", most)
        third, n = inventory.rescan(spark, str(root), first)
        assert n == 2 and {(r.rel_path, r.file_hash) for r in third.collect()} == {tuple(r) for r in inventory.scan(spark, str(root)).collect()}
    old = first.withColumn("file_hash", F.lit("kept"))
    assert {r.rel_path: r.file_hash for r in inventory.rescan(spark, str(root), old)[0].collect()}["a b/1.png"] == "kept"
