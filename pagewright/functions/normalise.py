"""Column functions that bring names, states and settings to their canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed vocabularies of the data model.
STATUSES = ("new", "layout_detecting", "layout_detected", "layout_reviewed", "ocr_extracting", "ocr_done", "ocr_reviewed", "ocr_failed")
CLASSES = ("section_header", "text", "list_item", "table", "picture", "picture_text", "caption", "footnote", "formula", "page_header", "page_footer")
EXCLUDED = ("picture_text",)  # classes that take no part in a benchmark
CAPTION_TARGETS = ("table", "picture", "formula")
HARD_CLASSES = ("table", "formula", "caption", "picture", "footnote", "list_item")
FORMATS = {"table": "html", "formula": "latex", "picture": "skip"}
QA_PHASES = ("bbox", "class", "order", "ocr")
BENCHMARK_STATUSES = ("LAYOUT_REVIEWED", "OCR_EXTRACTING", "OCR_DONE", "OCR_FAILED", "OCR_REVIEWED")
EXPORT_STATUSES = ("OCR_REVIEWED", "ocr_reviewed")
BATCH_STATUSES = ("layout_reviewed", "ocr_failed", "LAYOUT_REVIEWED", "OCR_FAILED")
QUOTA_TERMS = ("quota", "rate limit", "resource_exhausted", "429")
DAILY_TERMS = ("per day", "perday", "daily")
SERVER_TERMS = ("500", "502", "503", "504", "unavailable", "internal error")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; null becomes ''. Values without any skip the slower pattern."""
    return F.when(c.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(F.coalesce(c, F.lit("")))


def class_core(c: Column) -> Column:
    """Class name: each - and / is an underscore, then each run of white space is one. Names without white space skip the patterns."""
    plain = lambda x: F.translate(F.lower(x), "-/", "__")
    return F.when(c.rlike(r"(?U)\s"), F.regexp_replace(plain(strip(c)), r"(?U)\s+", "_")).otherwise(plain(F.coalesce(c, F.lit(""))))


def class_loose(c: Column) -> Column:
    """Class name with every run of separators as one underscore, as exports and screens show it."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)[\s/_-]+", "_")


def remapped(c: Column, **names: str) -> Column:
    """c with other names for some; by patterns, as a condition on c would compute it once more for each name."""
    out = c
    for old, new in names.items():
        out = F.regexp_replace(out, rf"\A{old}\z", new)
    return out


def class_detected(c: Column) -> Column:
    return remapped(class_core(c), title="section_header", list_item="text")


def class_persisted(c: Column) -> Column:
    return remapped(class_core(c), title="section_header")


def class_benchmark(c: Column) -> Column:
    """Null for a class that takes no part in a benchmark."""
    name = class_persisted(c)
    return F.when(~name.isin(*EXCLUDED), name)


def order_mode(c: Column) -> Column:
    mode = F.translate(F.lower(strip(c)), "_", "-")
    known = F.when(mode.isin("single", "multi-column", "two-page"), mode)
    return F.coalesce(F.when(mode == "single-column", "single"), known, F.lit("auto"))


def orientation(c: Column) -> Column:
    return F.when(F.translate(F.lower(strip(c)), "_", "-").isin("v", "ver", "vertical"), "vertical").otherwise("horizontal")


def status_upper(c: Column) -> Column:
    return F.upper(F.translate(strip(c), "- ", "__"))


def status_lower(c: Column) -> Column:
    return F.lower(status_upper(c))


def extraction_status(c: Column) -> Column:
    # one pattern instead of a condition, which would compute the name twice
    return F.regexp_replace(F.lower(strip(c)), r"\A(?!(?:ok|manual|failed|skip)\z)(?s:.*)\z", "ok")


def qa_status(c: Column) -> Column:
    return F.when(F.lower(strip(c)) == "reviewed", "reviewed").otherwise("pending")


def qa_phase(c: Column) -> Column:
    """The phase; an unknown one is an error."""
    phase = F.lower(strip(c))
    return F.when(phase.isin(*QA_PHASES), phase).otherwise(F.raise_error(F.concat(F.lit("unknown phase: "), phase)))


def expected_format(cls: Column) -> Column:
    """Output format of a class: an unknown one is written as markdown."""
    return F.coalesce(*[F.when(cls == k, v) for k, v in FORMATS.items()], F.lit("markdown"))


def requires_text(cls: Column) -> Column:
    return expected_format(cls) != "skip"


def output_matches(output_class: Column, output_format: Column, layout_class: Column) -> Column:
    return cores_match(class_core(output_class), F.lower(strip(output_format)), class_core(layout_class))


def can_preserve(previous: Column, following: Column, output_format: Column) -> Column:
    return cores_preserve(class_core(previous), class_core(following), F.lower(strip(output_format)))


def cores_match(output_class: Column, output_format: Column, layout_class: Column) -> Column:
    """output_matches of names that are canonical already; they are used several times, so they should be columns."""
    want = expected_format(layout_class)
    return (want != "skip") & (output_format == want) & (output_class == layout_class)


def cores_preserve(previous: Column, following: Column, output_format: Column) -> Column:
    new = expected_format(following)
    return (new == "markdown") & (expected_format(previous) == new) & (output_format == new)


def config_key(model: Column, size: Column, conf: Column, iou: Column) -> Column:
    return F.format_string("%s|%d|%.6f|%.6f", model, size, conf, iou)


def config_label(model: Column, size: Column, conf: Column) -> Column:
    return F.format_string("%s | imgsz=%d conf=%.2f", model, size, conf)


def key_alias(c: Column) -> Column:
    return F.when(F.length(c) <= 8, c).otherwise(F.concat(F.substring(c, 1, 4), F.lit("..."), F.right(c, F.lit(4))))


def stage_name(c: Column) -> Column:
    named = {"layout_detect": "layout detection", "layout_benchmark": "layout benchmark", "ocr_extract": "OCR extraction", "ocr_review": "OCR review"}
    return F.coalesce(F.when(F.coalesce(c, F.lit("")) == "", "pipeline"), *[F.when(c == k, v) for k, v in named.items()], F.translate(c, "_", " "))


def bounded_int(c: Column, default: int = 0, low: int | None = None, high: int | None = None) -> Column:
    """A whole number from any text, with a default and optional bounds."""
    out = F.coalesce(strip(c).try_cast("bigint"), F.lit(default))
    out = F.greatest(out, F.lit(low)) if low is not None else out
    return F.least(out, F.lit(high)) if high is not None else out


def holds_any(c: Column, terms: tuple[str, ...]) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def is_batch_payload(payload: Column) -> Column:
    trigger = F.get_json_object(payload, "$.trigger")
    return F.coalesce(F.lower(strip(trigger)) == "batch_ocr", F.lit(False))


def json_object(c: Column, schema: str) -> Column:
    """A parsed object; null, empty, invalid text and anything but an object give one of nulls."""
    is_object = F.ltrim(F.coalesce(c, F.lit(""))).startswith("{")
    return F.from_json(F.when(is_object, c), schema)


def is_safe_path(c: Column) -> Column:
    """Relative, below its root, and not empty."""
    parts = F.split(F.translate(c, "\\", "/"), "/")
    return (strip(c) != "") & ~c.startswith("/") & ~F.array_contains(parts, "..")
