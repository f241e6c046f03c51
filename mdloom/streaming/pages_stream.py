"""Incremental forms (T1-T4) with Structured Streaming.

* T1 ``stream_pages``: new snapshot files → pages whose URL key was not seen
  before (``dropDuplicates`` on the key; state lives in the checkpoint).
* T2 ``stream_failures``: cumulative failures per URL (streaming aggregate,
  update mode) → auto-skip flags.
* T3 restart: every query has a ``checkpointLocation``; sinks are idempotent
  (``foreachBatch`` writes each batch to a directory named by its batch id), so
  stopping and restarting yields the same rows.
* T4 ``stream_throughput``: successful fetches per minute of event time with a
  watermark, so late rows within the bound still count and state is dropped.

Run with ``trigger(availableNow=True)`` to process what is there and stop.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import urls as U
from mdloom.operators.attempts import DEFAULT_SKIP_AFTER

# --- fixed parameters ---------------------------------------------------------
WATERMARK = "10 minutes"
# -----------------------------------------------------------------------------


def _source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet")).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    path = os.path.join(sf_dir, f"{table}.parquet")
    if _is_folder(spark, path):  # a table written as part files
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming DataFrame of first-seen pages (page_id, url, url_key)."""
    pages = _source(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("url_key", U.normalize_url("url")).dropDuplicates(["url_key"])


def new_pages_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 input for ``run_first_per_key``: streaming pages with their URL key."""
    pages = _source(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("url_key", U.normalize_url("url"))


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_first_per_key(stream: DataFrame, key: str, order: str, out_dir: str, checkpoint: str) -> None:
    """T1 without per-key streaming state: each micro-batch keeps the first row
    per key (``min_by`` — partial aggregation, so a hot key ships one row per map
    task), drops keys already present in the output table (anti join) and writes
    ``out_dir/batch=<id>``. A replayed batch sees the same earlier batches and
    overwrites its own directory, so restarts are exactly-once."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c != key]
        first = batch.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r")).select(key, "_r.*")
        if _path_exists(spark, out_dir):
            seen = spark.read.parquet(out_dir).where(F.col("batch") < batch_id).select(key)
            first = first.join(seen, key, "left_anti")
        first.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            os.path.join(out_dir, f"batch={batch_id:010d}"))

    q = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative failures per URL (update mode)."""
    ev = _source(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("url_id"))
            .agg(F.count_if(F.col("event_type") == "error").alias("failures"),
                 F.count(F.lit(1)).alias("attempts"))
            .withColumn("auto_skip", F.col("failures") >= DEFAULT_SKIP_AFTER))


def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: successful fetches per event-time minute, watermarked (append mode)."""
    ev = _source(spark, sf_dir, "events").where(F.col("event_type") != "error")
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))
    return (ev.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 minute"))
            .agg(F.count(F.lit(1)).alias("pages")))


def run_to_table(stream: DataFrame, out_dir: str, checkpoint: str, mode: str = "append",
                 keys: list[str] | None = None) -> None:
    """Run ``stream`` to completion (availableNow) into parquet under ``out_dir``.

    append: each micro-batch writes ``out_dir/batch=<id>`` (overwrite of the same
    id on replay → exactly-once). update/complete: each batch's rows are the new
    values of their keys; readers take the row of the highest batch per key."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            os.path.join(out_dir, f"batch={batch_id:010d}"))

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()


def read_table(spark: SparkSession, out_dir: str, keys: list[str] | None = None) -> DataFrame:
    """Read a ``run_to_table`` output; with ``keys``, the latest row per key."""
    df = spark.read.parquet(out_dir)
    if keys:
        df = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]),
                                            F.col("_batch")).alias("_r")).select(*keys, "_r.*")
    return df.drop("_batch", "batch")
