"""Log files of the crawl, rendered from the attempt log with stack traces, and the
queries that read them back as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.plans import runs as R
from mdloom.session import scratch_path
from mdloom.sources import log_records as LR

#: The records of one host family are the ones that the second query asks for.
URL_PART = ".example.net/"


def write_log_files(attempts: DataFrame, path: str) -> None:
    """Attempts in time order as log files: a failed one is an error (every seventh id a
    critical one) with a trace of id % 4 lines, every tenth good one a line of its own below."""
    aid = F.col("attempt_id")
    level = F.when(~F.col("failed"), F.lit("INFO")).when(aid % 7 == 0, F.lit("CRITICAL")).otherwise(F.lit("ERROR"))
    head = F.format_string("%s - web_crawler - %s - %s | url=%s | attempt=%d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level,
                           F.when(F.col("failed"), F.lit("fetch failed")).otherwise(F.lit("fetched")), "url", "attempt_id")
    trace = F.array(F.lit("Traceback (most recent call last):"), F.format_string('  File "fetch.py", line %d, in get', aid % 500),
                    F.format_string("TimeoutError: attempt %d", aid))
    below = (F.when(F.col("failed"), F.slice(trace, 1, (aid % 4).cast("int")))
             .when(aid % 10 == 3, F.array(F.lit("ERROR is only a word of this line"))).otherwise(F.array().cast("array<string>")))
    text = F.array_join(F.concat(F.array(head), below), "\n")
    (attempts.repartitionByRange("ts", "attempt_id").sortWithinPartitions("ts", "attempt_id").select(text.alias("value"))
     .write.mode("overwrite").text(path))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "crawl-log")
    write_log_files(R.site_attempts(spark, sf_dir), path)
    return LR.with_heads(LR.read_lines(spark, path))


def q_log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every line of the error records, with its place in the record."""
    e = LR.error_lines(_lines(spark, sf_dir))
    return e.select(F.col("ctx")["attempt"].cast("long").alias("attempt_id"), "level",
                    (F.col("line_no") - F.col("head_line")).alias("place"), "value")


def q_log_error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the error records that mention a URL part: lines and last line of each."""
    e = LR.error_records(LR.error_lines(_lines(spark, sf_dir), URL_PART))
    return e.select(F.col("ctx")["attempt"].cast("long").alias("attempt_id"), "level", "n_lines", "last_line")
