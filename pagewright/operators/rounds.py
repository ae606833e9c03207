"""Extraction of crops in rounds, with the state of keys and crops in tables that outlive any worker.

A round deals each open crop to one of the keys that it may use, makes one call
for it, and writes what came of it; closed crops stay in the round that closed
them. A key that has not answered in this run is tried with one crop first, and
no call of that round or a later one uses a key that was found exhausted. The
crops of a key are called from all tasks; where its day ends within a round,
each of them finds that out by at most one call. When no key is left, the pool
is tried once more. A run that was interrupted goes on after its last round.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import DAILY_TERMS, QUOTA_TERMS
from ..sources.providers import exhausted_keys
from ..sources.tables import loaded_json, saved_json

SCHEMA = "layout_id long, prompt string, key string, failures int, requests int, refused array<string>, state string, raw string, error string, daily boolean"
OPEN, DONE, FAILED, SKIPPED = "open", "extracted", "failed", "skipped"


def _called(batches: Iterator[pa.RecordBatch], make: Callable[[], Callable[[str, str], str]], attempts: int, spent: list[str]) -> Iterator[pa.RecordBatch]:
    """One call for each open crop that has a key; crops of a key whose day is used up stay open without one."""
    call, over = make(), set(spent)
    for batch in batches:
        of = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for i, (state, key, prompt) in enumerate(zip(of["state"], of["key"], of["prompt"])):
            if state != OPEN or key is None or key in over:
                continue
            try:
                of["raw"][i], of["error"][i], of["state"][i] = call(key, prompt), None, DONE
                of["requests"][i] += 1
                continue
            except Exception as e:  # noqa: BLE001  any failure of a provider is data here
                of["error"][i] = str(e)
            low = of["error"][i].lower()
            if any(t in low for t in QUOTA_TERMS):
                of["refused"][i] = [*(of["refused"][i] or ()), key]
                if any(t in low for t in DAILY_TERMS):
                    of["daily"][i] = True
                    over.add(key)
            else:
                of["failures"][i] += 1
                of["state"][i] = FAILED if of["failures"][i] >= attempts else OPEN
        same = ("layout_id", "prompt", "key")
        yield pa.RecordBatch.from_arrays([batch.column(n) if n in same else pa.array(of[n], batch.schema.field(n).type) for n in batch.schema.names], schema=batch.schema)


def extracted(crops: DataFrame, make: Callable[[], Callable[[str, str], str]], keys: list[str], folder: str, attempts: int = 2) -> DataFrame:
    """(layout_id, state, raw, error, used_key, requests) of crops: layout_id, prompt; make builds call(key, prompt) once in each task.

    folder: holds the rounds, the crops that keys were tried with, and, as a JSON list, the exhausted keys. An empty
    prompt is skipped. Keys are configuration: a list of a few. A call that is
    refused for its quota is left to another key; other failures count, and a
    crop is failed after `attempts` of them or when no key is left for it.
    """
    spark, keys = crops.sparkSession, list(dict.fromkeys(keys))
    progress = loaded_json(spark, f"{folder}/progress", {"round": -1, "revalidated": False})
    # the first round that counts: of a run that was begun when each round still held all crops, the last one then
    progress.setdefault("first", max(0, progress["round"]))
    answering: set[str] = set()
    stored = lambda kind, n: f"{folder}/{kind}={n}"
    spent: list[str] = exhausted_keys(json.dumps(loaded_json(spark, f"{folder}/exhausted", [])))
    if progress["round"] < 0:
        start = crops.select(
            F.col("layout_id").cast("long"), F.col("prompt").cast("string"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("failures"), F.lit(0).alias("requests"), F.array().cast("array<string>").alias("refused"),
            F.when(F.coalesce("prompt", F.lit("")) == "", SKIPPED).otherwise(OPEN).alias("state"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("daily"),
        )
        start.write.mode("overwrite").parquet(stored("round", 0))
        progress["round"] = 0
        saved_json(spark, f"{folder}/progress", progress)
    while True:
        now = open_ = spark.read.schema(SCHEMA).parquet(stored("round", progress["round"])).where(F.col("state") == OPEN)
        usable = F.array(*[F.lit(k) for k in keys if k not in spent]).cast("array<string>")
        free = F.array_except(usable, F.coalesce("refused", F.array().cast("array<string>")))
        dealt = F.when(F.size(free) > 0, F.get(free, F.pmod(F.xxhash64("layout_id", F.lit(progress["round"])), F.size(free)).cast("int")))
        if open_.isEmpty():
            break
        stuck = open_.where(F.size(free) == 0)
        if spent and not progress["revalidated"] and not stuck.isEmpty():
            # once a run, the whole pool again; what crops were refused is forgotten
            spent, progress = [], progress | {"revalidated": True}
            usable = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
            now = now.withColumn("refused", F.array().cast("array<string>"))
            dealt = F.get(usable, F.pmod(F.xxhash64("layout_id", F.lit(progress["round"])), F.lit(max(1, len(keys)))).cast("int"))
        rows = now.withColumn("key", dealt)
        ends = F.col("key").isNull()
        rows = rows.withColumn("error", F.when(ends, F.coalesce("error", F.lit("no usable key"))).otherwise(F.col("error"))).withColumn("state", F.when(ends, FAILED).otherwise(F.col("state"))).withColumn("daily", F.lit(False))
        progress = progress | {"round": progress["round"] + 1}
        path, tried, over = stored("round", progress["round"]), None, []
        new = [k for k in keys if k not in spent and k not in answering]
        if new:
            # one crop of each key that has not answered yet; there are a few keys
            least = rows.where(F.col("key").isin(new)).groupBy("key").agg(F.min("layout_id").alias("layout_id"))
            first = rows.join(F.broadcast(least), ["layout_id", "key"], "left_semi").select(*rows.columns)
            first.repartition(len(new), "key").mapInArrow(lambda it: _called(it, make, attempts, []), SCHEMA).write.mode("overwrite").parquet(stored("tried", progress["round"]))
            tried = spark.read.schema(SCHEMA).parquet(stored("tried", progress["round"]))
            found = {r["key"]: r["daily"] for r in tried.groupBy("key").agg(F.max("daily").alias("daily")).collect()}
            over, answering = [k for k in found if found[k]], answering | set(found)
            rows = rows.join(F.broadcast(tried.select("layout_id", "key")), ["layout_id", "key"], "left_anti").select(*rows.columns)
        # crops stay where they are: a key's are not brought together
        done = rows.mapInArrow(lambda it, over=over: _called(it, make, attempts, over), SCHEMA)
        (done if tried is None else done.unionByName(tried)).write.mode("overwrite").parquet(path)
        ended = [r[0] for r in spark.read.schema(SCHEMA).parquet(path).where("daily").select("key").distinct().collect()]  # keys
        spent = [*spent, *(k for k in ended if k not in spent)]
        answering -= set(spent)
        saved_json(spark, f"{folder}/exhausted", spent)
        saved_json(spark, f"{folder}/progress", progress)
    every = [spark.read.schema(SCHEMA).parquet(stored("round", n)).where(F.col("state") != OPEN) for n in range(progress["first"], progress["round"] + 1)]
    out = reduce(DataFrame.unionByName, every)
    return out.select("layout_id", "state", "raw", "error", F.when(F.col("state") == DONE, F.col("key")).alias("used_key"), "requests")


def counters(results: DataFrame) -> DataFrame:
    """One row: extracted, skipped, failed and requests, of which each was answered."""
    of = lambda state: F.count_if(F.col("state") == state)
    return results.agg(of(DONE).alias("extracted"), of(SKIPPED).alias("skipped"), of(FAILED).alias("failed"), F.coalesce(F.sum("requests"), F.lit(0)).cast("long").alias("requests"))
