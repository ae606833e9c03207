"""The job queue and event log as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as N

PAYLOAD = "trigger string, batch_run_id string, batch_total_layouts long, layout_ids array<long>"
RESULT = "extracted_count long, skipped_count long, skipped boolean, progress struct<processed_layouts:long,total_layouts:long>"


def batch_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs of batch extraction with their run, total and processed boxes; a job without a run is a run of its own."""
    p = N.json_object(F.col("payload_json"), PAYLOAD)
    r = N.json_object(F.col("result_json"), RESULT)
    rows = jobs.where(N.is_batch_payload(F.col("payload_json"))).withColumn("p", p).withColumn("r", r)
    run = F.coalesce(F.when(N.strip(F.col("p.batch_run_id")) != "", N.strip(F.col("p.batch_run_id"))), F.concat(F.lit("legacy:"), F.col("job_id").cast("string")))
    ids = F.size(F.array_distinct(F.filter(F.coalesce("p.layout_ids", F.array().cast("array<bigint>")), lambda x: x > 0)))
    done = F.coalesce("r.extracted_count", F.lit(0)) + F.coalesce("r.skipped_count", F.lit(0))
    processed = F.when(F.col("status").isin("completed", "failed"), F.when(F.col("status") == "completed", F.greatest(ids, done)).otherwise(done)).when(F.col("status") == "running", F.coalesce("r.progress.processed_layouts", F.lit(0))).otherwise(0)
    total = F.greatest(ids.cast("long"), F.coalesce("r.progress.total_layouts", F.lit(0)))
    return rows.select("job_id", "status", run.alias("run"), total.alias("total"), F.least(F.greatest(processed, F.lit(0)), total).cast("long").alias("processed"), F.coalesce("p.batch_total_layouts", F.lit(0)).alias("hint"))


def run_progress(jobs: DataFrame) -> DataFrame:
    """Per run: jobs, total (a hint may raise it), processed (within the total), and the largest active job."""
    rows = batch_jobs(jobs).groupBy("run").agg(
        F.count("*").alias("jobs"), F.greatest(F.sum("total"), F.max("hint")).alias("total"), F.sum("processed").alias("done"), F.max(F.when(F.col("status").isin("queued", "running"), F.col("job_id"))).alias("active_job")
    )
    return rows.select("run", "jobs", "total", F.least("total", "done").alias("processed"), "active_job")


def enqueued(jobs: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("stage", "page_id")) -> DataFrame:
    """Of the wanted jobs (seq and keys) the first of each key that no active job has."""
    active = jobs.where(F.col("status").isin("queued", "running")).select(*keys)
    first = Window.partitionBy(*keys).orderBy("seq")
    return wanted.join(active, list(keys), "left_anti").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def claimed(jobs: DataFrame) -> DataFrame:
    """The job that a worker takes next: the lowest queued id, with one more attempt."""
    return jobs.where("status = 'queued'").orderBy("job_id").limit(1).select("job_id", "stage", F.lit("running").alias("status"), (F.col("attempts") + 1).alias("attempts"))


def stopped(jobs: DataFrame, stage: str, error: str = "Stopped by user request.") -> DataFrame:
    """Jobs of a stage after a stop: queued ones failed with an error, running ones flagged."""
    mine = F.col("stage") == stage
    queued, running = mine & (F.col("status") == "queued"), mine & (F.col("status") == "running")
    return jobs.select("job_id", F.when(queued, "failed").otherwise(F.col("status")).alias("status"), F.when(queued, error).alias("error"), running.alias("stop_requested"))


def status_of_event(stage: Column, event_type: Column, skipped: Column) -> Column:
    """The page state that an event implies, else null; a skipped completion implies none."""
    done = event_type == "job_completed"
    states = (
        ((stage == "layout_detect") & (event_type == "job_started"), "layout_detecting"),
        ((stage == "layout_detect") & done & ~skipped, "layout_detected"),
        ((stage == "layout_detect") & (event_type == "job_failed"), "new"),
        ((stage == "layout_review") & (event_type == "manual_review_completed"), "layout_reviewed"),
        ((stage == "ocr_extract") & (event_type == "job_started"), "ocr_extracting"),
        ((stage == "ocr_extract") & done & ~skipped, "ocr_done"),
        ((stage == "ocr_extract") & (event_type == "job_failed"), "ocr_failed"),
        ((stage == "ocr_review") & (event_type == "manual_review_completed"), "ocr_reviewed"),
    )
    return F.coalesce(*[F.when(test, state) for test, state in states])


def latest_states(events: DataFrame) -> DataFrame:
    """(page_id, status, id) from the last event of each page that implies a state."""
    rows = events.withColumn("status", status_of_event(F.col("stage"), F.col("event_type"), F.col("skipped"))).where("status IS NOT NULL AND stage <> 'layout_benchmark'")
    return rows.groupBy("page_id").agg(F.max_by("status", "id").alias("status"), F.max("id").alias("id"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both tables, the last of each key by the order columns."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return old.unionByName(new).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
