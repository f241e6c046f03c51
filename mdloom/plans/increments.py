"""Registered queries of the resumable streams (T1-T4): the tables arrive in slices, a run
after each takes what is new, and one run is lost between its writes and its commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import urls as U
from mdloom.session import scratch_path
from mdloom.sources.pages import attempts_from_events, read_table
from mdloom.streaming import pages_stream as ST
from mdloom.streaming import resumable as RS

#: Slices in which a table arrives, and the run that is lost once.
SLICES = 4
LOST = 2
#: How late a fetch may be logged and still count.
LATENESS = "2 days"


def _slice_of(df: DataFrame, place) -> DataFrame:
    """``slice``: the even part of the range of ``place`` (a long) that a row stands in."""
    lo, hi = df.agg(F.min(place)).scalar(), df.agg(F.max(place)).scalar()
    return df.withColumn("slice", F.least(F.lit(SLICES - 1), F.call_function("div", (place - lo) * SLICES, hi - lo + 1)).cast("int"))


def _arrive(spark: SparkSession, sliced: DataFrame, base: str, run) -> None:
    """Write the slices one after another; ``run(stream, crash_at)`` after each, the lost one twice."""
    rows = sliced.drop("slice")
    for n in range(SLICES):
        sliced.where(F.col("slice") == n).drop("slice").write.mode("append").parquet(f"{base}/arrived")
        for crash_at in ([n, None] if n == LOST else [None]):
            run(spark.readStream.schema(rows.schema).parquet(f"{base}/arrived"), crash_at)


def _events_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts_from_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return _slice_of(a, F.unix_micros("ts"))


def q_stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each URL key over four arrivals and a lost run. Every second page of a slice comes again,
    under a greater id, with the next one."""
    base = scratch_path(spark, "stream-restart")
    pages = _slice_of(read_table(spark, sf_dir, "pages").select("page_id", "url", U.normalize_url("url").alias("url_key")), F.col("page_id"))
    again = pages.where((F.col("page_id") % 2 == 0) & (F.col("slice") < SLICES - 1)).select(
        (-F.col("page_id") - 1).alias("page_id"), "url", "url_key", (F.col("slice") + 1).alias("slice"))
    _arrive(spark, pages.unionByName(again), base, lambda stream, crash_at: RS.run_new_pages(stream, base, crash_at=crash_at))
    return ST.read_table(spark, f"{base}/out").select("url_key", "page_id")


def q_stream_auto_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt flagged in the run that it arrives in, over a lost run."""
    base = scratch_path(spark, "stream-auto-skip")
    _arrive(spark, _events_sliced(spark, sf_dir), base, lambda stream, crash_at: RS.run_auto_skip(stream, base, crash_at=crash_at))
    return ST.read_table(spark, f"{base}/out")


def q_stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: successful fetches per minute of event time, in append mode under a watermark. Every fifth attempt is logged a slice late;
    what is later than the bound is dropped, and minutes within it at the end are still open."""
    base = scratch_path(spark, "stream-throughput")
    late = F.when(F.col("attempt_id") % 5 == 0, F.least(F.col("slice") + 1, F.lit(SLICES - 1))).otherwise(F.col("slice"))
    sliced = _events_sliced(spark, sf_dir).withColumn("slice", late).where(~F.col("failed")).select("attempt_id", "ts", "slice")

    def run(stream: DataFrame, crash_at: int | None) -> None:
        if crash_at is None:  # the lost run is of no interest here
            per = stream.withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("pages"))
            ST.run_to_table(per, f"{base}/out", f"{base}/checkpoint")
    _arrive(spark, sliced, base, run)
    return ST.read_table(spark, f"{base}/out").select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "pages")
