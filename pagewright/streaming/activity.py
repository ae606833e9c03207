"""The event log as a stream: page states and activity counts that follow new events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.jobs import status_of_event

SCHEMA = "id long, ts timestamp, page_id long, stage string, event_type string, skipped boolean, message string"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Events appended as files to a folder; a bounded number of files a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def states(events: DataFrame) -> DataFrame:
    """The last implied state of each page, kept as streaming state and updated with each batch."""
    rows = events.withColumn("status", status_of_event(F.col("stage"), F.col("event_type"), F.col("skipped"))).where("status IS NOT NULL AND stage <> 'layout_benchmark'")
    return rows.groupBy("page_id").agg(F.max_by("status", "id").alias("status"), F.max("id").alias("id"))


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by stage and type in windows of event time; later ones than the watermark are dropped, and with them their state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "stage", "event_type").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def applied_states(events: DataFrame) -> DataFrame:
    """(page_id, id, status) of the pages whose state changes, from keyed state that survives restarts.

    The state of a page is the id of the last event that it has taken and its
    status. Events up to that id are known and do nothing, so a batch that is
    delivered again changes nothing; if all that come have lower ids, the log was
    begun anew and they count from its start. Events of the benchmark stage move
    the cursor and nothing else.
    """

    def update(key, parts, state):
        last, status = state.get if state.exists else (0, None)
        rows = pd.concat(list(parts)).sort_values("id", kind="stable")
        if rows["id"].max() < last:
            last = 0
        before = status
        rows = rows[rows["id"] > last]
        if len(rows):
            last = int(rows["id"].iloc[-1])
            implied = rows.loc[rows["status"].notna() & (rows["stage"] != "layout_benchmark"), "status"]
            status = implied.iloc[-1] if len(implied) else status
        state.update((last, status))
        if status != before:
            yield pd.DataFrame({"page_id": [key[0]], "id": [last], "status": [status]})

    rows = events.where("page_id > 0 AND id > 0").select("page_id", "id", "stage", status_of_event(F.col("stage"), F.col("event_type"), F.col("skipped")).alias("status"))
    return rows.groupBy("page_id").applyInPandasWithState(update, "page_id long, id long, status string", "id long, status string", "update", GroupStateTimeout.NoTimeout)


def to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "update", once: bool = True) -> StreamingQuery:
    """Run a stream into an in-memory table, to the end of what there is or every two seconds."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def upsert_batches(df: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet table with the last row of each key; each batch writes a new version folder, so a repeated batch changes nothing.

    The version before stays, for a batch that is repeated; older ones go.
    """

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v={version - 1}"
        rows = batch
        if version > 0:
            kept = spark.read.schema(batch.schema).parquet(old).join(batch.select(key), key, "left_anti")
            rows = kept.unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{path}/v={version}")
        if version > 1 and (jvm := getattr(spark, "_jvm", None)) is not None:
            old = jvm.org.apache.hadoop.fs.Path(f"{path}/v={version - 2}")
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
