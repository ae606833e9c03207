"""Keyed tables in folders that all executors share: written steps, small JSON files, and a table merged by buckets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

BUCKETS = 64


def written(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder of spark.checkpoint.dir: what it took is not done again."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/staging")
    return df.checkpoint()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def saved_json(spark: SparkSession, path: str, value) -> None:
    """Write a small value to a path of any store that Spark writes to, in place of what is there."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def loaded_json(spark: SparkSession, path: str, default=None):
    files, at = _file_system(spark, path)
    if not files.exists(at):
        return default
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, at = _file_system(spark, path)
    return sorted(int(s.getPath().getName().removeprefix("v=")) for s in files.listStatus(at)) if files.exists(at) else []


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _folders(path: str, manifest: dict) -> list[str]:
    return [f"{path}/data/v={v}/bucket__={b}" for b, v in sorted(manifest["at"].items(), key=lambda x: int(x[0]))]


def merged(spark: SparkSession, path: str, batch: DataFrame, key: list[str], version: int, order: str | None = None, buckets: int = BUCKETS) -> int:
    """Merge rows by key into the table at path as a version; how many buckets were written.

    Only buckets that the batch has keys of are read and written anew; a manifest
    for each version says in which folder each bucket stands. A version that is
    merged again begins from the one before it and gives the same table. Of
    several rows of a key in the batch that of the greatest order stays.
    """
    before = [v for v in _versions(spark, f"{path}/manifest") if v < version]
    manifest = loaded_json(spark, f"{path}/manifest/v={before[-1]}") if before else {"buckets": buckets, "at": {}}
    columns = batch.columns
    rows = batch.withColumn("bucket__", _bucket(key, manifest["buckets"]))
    if order:
        rest = [c for c in columns if c not in key]
        rows = rows.groupBy(*key, "bucket__").agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*[F.col(k) if k in key else F.col(f"__last.{k}").alias(k) for k in columns], "bucket__")
    rows = written(rows)
    touched = [r[0] for r in rows.select("bucket__").distinct().collect()]  # as many as there are buckets at most
    old = [f"{path}/data/v={manifest['at'][str(b)]}/bucket__={b}" for b in touched if str(b) in manifest["at"]]
    if old:
        kept = spark.read.schema(batch.schema).parquet(*old).withColumn("bucket__", _bucket(key, manifest["buckets"]))
        rows = kept.join(rows.select(*key), key, "left_anti").select(*columns, "bucket__").unionByName(rows)
    if touched:
        rows.repartition(min(len(touched), 256), "bucket__").write.mode("overwrite").partitionBy("bucket__").parquet(f"{path}/data/v={version}")
    now = {"buckets": manifest["buckets"], "at": manifest["at"] | {str(b): version for b in touched}}
    saved_json(spark, f"{path}/manifest/v={version}", now)
    # what neither this version nor the one before it names goes; a repeated batch needs the one before
    named = {*_folders(path, now), *_folders(path, manifest)}
    older = loaded_json(spark, f"{path}/manifest/v={before[-2]}") if len(before) > 1 else None
    for folder in _folders(path, older) if older else []:
        if folder not in named:
            files, at = _file_system(spark, folder)
            files.delete(at, True)
    return len(touched)


def table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a merged table, or a given one that still stands."""
    versions = _versions(spark, f"{path}/manifest")
    if not versions:
        raise ValueError(f"no table at {path}")
    folders = _folders(path, loaded_json(spark, f"{path}/manifest/v={versions[-1] if version is None else version}"))
    return spark.read.parquet(*folders)


def merge_stream(df: DataFrame, path: str, key: list[str], checkpoint: str, order: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge each batch of a stream into the table at path, to the end of what there is."""
    write = lambda batch, version: merged(batch.sparkSession, path, batch, key, version, order, buckets) and None
    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
