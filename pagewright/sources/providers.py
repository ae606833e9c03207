"""Interfaces to detectors and transcribers, which run outside of Spark's operators.

A provider is a callable that is created once in each Python worker. Without a
model or a network, `recorded` serves detections and transcripts from a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import DAILY_TERMS, FORMATS, QUOTA_TERMS, strip

PLACEHOLDERS = ("class_rule", "format_rule")


def response_text(raw: Column) -> Column:
    """The joined text parts of the first candidate of a response in which they are not blank."""
    parsed = F.from_json(raw, "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>")
    texts = F.transform(parsed["candidates"], lambda c: F.array_join(F.transform(F.filter(c["content"]["parts"], lambda p: p["text"].isNotNull()), lambda p: p["text"]), ""))
    return F.get(F.filter(texts, lambda t: strip(t) != ""), F.lit(0))


def content_of(raw: Column) -> Column:
    """(content, error) of a response that has to be a JSON object with the one key content, a string."""
    v = F.try_parse_json(raw)
    keys = F.json_object_keys(F.when(v.isNotNull(), raw))
    error = (
        F.when(v.isNull(), "not JSON")
        .when(~F.ltrim(raw).startswith("{"), "not an object")
        .when((F.size(keys) != 1) | (keys[0] != "content"), "unexpected keys")
        .when(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) != "STRING", "content is not a string")
    )
    return F.struct(F.when(error.isNull(), F.try_variant_get(v, "$.content", "string")).alias("content"), error.alias("error"))


def rendered_prompt(template: str, class_rule: Column, format_rule: Column, cls: Column) -> Column:
    """A prompt template with its two rules filled in; '' for a class that is skipped."""
    import re

    unknown = set(re.findall(r"\{(\w+)\}", template)) - set(PLACEHOLDERS)
    if unknown or not template.strip():
        raise ValueError(f"template with placeholders {sorted(unknown)}" if unknown else "empty template")
    text = F.replace(F.replace(F.lit(template), F.lit("{class_rule}"), class_rule), F.lit("{format_rule}"), format_rule)
    return F.when(cls.isin(*[k for k, v in FORMATS.items() if v == "skip"]), "").otherwise(strip(text))


def detected(pages: DataFrame, make: Callable[[], Callable[[str, dict], list[dict]]], params: dict) -> DataFrame:
    """(page_id, class_name, confidence, box) of every page; make builds a detector once in each worker."""
    schema = "page_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = make()
        for batch in batches:
            rows = [{"page_id": i, **d} for i, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for d in detect(path, params)]
            rows = [r for r in rows if r["x2"] > r["x1"] and r["y2"] > r["y1"]]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("class_name", pa.string()), *((c, pa.float64()) for c in ("confidence", "x1", "y1", "x2", "y2"))]))

    return pages.select("page_id", "rel_path").mapInArrow(run, schema)


class KeyRing:
    """The keys of one worker, taken in turn. Keys whose day is used up stay out, until the whole pool is tried once more."""

    def __init__(self, keys: tuple[str, ...], exhausted: tuple[str, ...] = ()):
        self.keys, self.exhausted = list(dict.fromkeys(keys)), set(exhausted)
        self.turn, self.tried_again = 0, False

    def pick(self, refused: set[str]) -> str | None:
        """The next key that may be used, or None; refused keys are out for this crop."""
        free = [k for k in self.keys if k not in self.exhausted and k not in refused]
        if not free and self.exhausted and not self.tried_again:
            self.tried_again = True
            self.exhausted.clear()
            refused.clear()
            free = self.keys
        if not free:
            return None
        self.turn += 1
        return free[(self.turn - 1) % len(free)]


def _transcript(call: Callable[[str, str], str], prompt: str, ring: KeyRing, attempts: int) -> tuple[str | None, str | None, str | None, int]:
    """(text, error, key, calls) of one prompt. A key that is over its quota is left for the next one; other failures count as attempts."""
    refused: set[str] = set()
    error, failures, calls = None, 0, 0
    while failures < attempts:
        key = ring.pick(refused)
        if key is None:
            return None, error or "no usable key", None, calls
        calls += 1
        try:
            return call(key, prompt), None, key, calls
        except Exception as e:  # noqa: BLE001  any failure of a provider is data here
            error = str(e)
        low = error.lower()
        if any(t in low for t in QUOTA_TERMS):
            refused.add(key)
            if any(t in low for t in DAILY_TERMS):
                ring.exhausted.add(key)
        else:
            failures += 1
    return None, error, None, calls


def transcribed(crops: DataFrame, make: Callable[[], Callable[[str, str], str]], keys: tuple[str, ...] = ("",), exhausted: tuple[str, ...] = (), attempts: int = 2) -> DataFrame:
    """(layout_id, raw, error, used_key, calls) for each crop's prompt; make builds call(key, prompt) once in each worker."""
    kinds = [("layout_id", pa.int64()), ("raw", pa.string()), ("error", pa.string()), ("used_key", pa.string()), ("calls", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, ring = make(), KeyRing(keys, exhausted)
        for batch in batches:
            rows = [(i, *_transcript(call, prompt, ring, attempts)) for i, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return crops.select("layout_id", "prompt").mapInArrow(run, "layout_id long, raw string, error string, used_key string, calls int")


def exhausted_keys(text: str) -> list[str]:
    """Keys of a file of used-up keys, a JSON list: trimmed, each once; any other file has none."""
    try:
        found = json.loads(text)
    except ValueError:
        return []
    return list(dict.fromkeys(x for x in (str(v).strip() for v in found) if x)) if isinstance(found, list) else []


def prompt_sheet(spark, template: str) -> DataFrame:
    """One row with the prompts of all classes as a text."""
    from ..functions.normalise import CLASSES, expected_format

    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, CLASSES))).alias("n", "cls")).withColumn("f", expected_format(F.col("cls")))
    prompt = rendered_prompt(template, F.translate("cls", "_", " "), F.col("f"), F.col("cls"))
    part = F.concat(F.lit("## "), F.col("cls"), F.lit("\n- format: "), F.col("f"), F.lit("\n"), F.when(F.col("f") == "skip", "not sent").otherwise(prompt))
    parts = F.array_sort(F.collect_list(F.struct("n", part.alias("p"))))
    return rows.agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n").alias("sheet"))
