"""Per-site run tables derived from the snapshot and the attempt log: error
events (G1), run counters (A1, A2) and the inputs of the advisor (A6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.operators import errors as OE
from mdloom.operators.attempts import DEFAULT_SKIP_AFTER
from mdloom.plans import corpus as C
from mdloom.sources.pages import attempts_from_events, page_scan

# --- fixed parameters of the derived runs (the default profile) --------------
REQUEST_DELAY = 1.0
CONSOLE_LEVEL = "INFO"
# -----------------------------------------------------------------------------


def site_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with the URL and site of the page they fetched (url_id = page_id)."""
    a = attempts_from_events(spark, sf_dir)
    p = page_scan(spark, sf_dir).select(F.col("page_id").alias("url_id"), "url", "host")
    return a.join(p, "url_id")


def site_errors(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """G1: network errors (one per failed attempt, crawler) and content-extraction
    errors (body fallback LOW / no content MEDIUM, converter) in one table."""
    att = site_attempts(spark, sf_dir).where("failed")
    net = att.select(F.lit("crawler").alias("source"), F.lit("network_error").alias("error_type"),
                     F.lit("MEDIUM").alias("severity"), "url", F.lit("fetch failed").alias("message"),
                     "host")
    d = docs if docs is not None else C.documents(C.parsed_pages(spark, sf_dir))
    content = d.where(F.col("error_severity").isNotNull()).select(
        F.lit("converter").alias("source"), F.lit("content_extraction_error").alias("error_type"),
        F.col("error_severity").alias("severity"), "url",
        F.when(F.col("source") == "body", F.lit("content root not found, body used"))
        .otherwise(F.lit("no content root and no body")).alias("message"), "host")
    return _union_with_host(net, content)


def _union_with_host(net: DataFrame, content: DataFrame) -> DataFrame:
    cols = OE.ERROR_COLUMNS + ["host"]
    return net.select(*[c if c in net.columns else F.lit(None).cast("string").alias(c) for c in cols]) \
        .unionByName(content.select(*[c if c in content.columns else F.lit(None).cast("string").alias(c)
                                      for c in cols]))


def site_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run row per site with the counters the advisor reads."""
    docs = C.documents(C.parsed_pages(spark, sf_dir))
    page_side = docs.groupBy("host").agg(
        F.countDistinct("url_key").alias("total_crawled"),
        (F.count(F.lit(1)) - F.countDistinct("url_key")).alias("total_skipped"),
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(F.col("status") == "success").alias("total_success"),
        F.count_if(F.col("status") == "failed").alias("convert_failed"),
        F.count_if(F.col("error_severity").isNotNull()).alias("content_errors"))
    # attempts are counted per URL before the join, so a URL fetched very often is one row in it
    per_url = (attempts_from_events(spark, sf_dir).groupBy("url_id")
               .agg(F.count_if("failed").alias("f"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
               .join(page_scan(spark, sf_dir).select(F.col("page_id").alias("url_id"), "host"), "url_id"))
    att_side = per_url.groupBy("host").agg(
        F.sum("f").alias("total_failed"),
        F.count_if(F.col("f") >= DEFAULT_SKIP_AFTER).alias("auto_skipped"),
        F.timestamp_diff("MICROSECOND", F.min("t0"), F.max("t1")).alias("_span_us"))
    runs = page_side.join(att_side, "host", "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return runs.select(
        F.col("host").alias("run_id"),
        z("total_crawled").alias("total_crawled"), z("total_failed").alias("total_failed"),
        z("total_skipped").alias("total_skipped"), z("auto_skipped").alias("auto_skipped"),
        z("total_processed").alias("total_processed"), z("total_success").alias("total_success"),
        z("convert_failed").alias("convert_failed"),
        F.lit(0).cast("long").alias("images_downloaded"), F.lit(0).cast("long").alias("images_failed"),
        z("total_failed").alias("network_errors"), z("content_errors").alias("content_errors"),
        F.lit(0).cast("long").alias("fs_errors"), F.lit(0).cast("long").alias("config_errors"),
        (F.coalesce(F.col("_span_us"), F.lit(0)) / 1e6).alias("seconds"),
        F.lit(REQUEST_DELAY).alias("request_delay"), F.lit(CONSOLE_LEVEL).alias("console_level"))


def varied_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per page whose counters, delay and level follow from the digits of its URL's digest, so that every rule fires
    for some and not for others; one in sixteen did nothing at all."""
    d = lambda i: F.conv(F.substring(F.md5("run_id"), i, 1), 16, 10).cast("long")
    busy = F.when(d(11) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    level = F.when(d(9) % 4 == 0, F.lit("DEBUG")).when(d(9) % 4 > 1, F.lit("INFO"))
    crawled, failed = (10 + d(1) * 6) * busy, d(2) * 4 * busy
    return page_scan(spark, sf_dir).select(F.col("url").alias("run_id")).select(
        "run_id", crawled.alias("total_crawled"), failed.alias("total_failed"), (d(7) * d(7) * busy).alias("total_skipped"),
        crawled.alias("total_processed"), (d(4) * 12).alias("images_downloaded"), (d(5) * 8).alias("images_failed"), failed.alias("network_errors"),
        F.floor(crawled * d(3) / 40).alias("content_errors"), F.when(d(10) % 4 == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("fs_errors"),
        F.lit(0).cast("long").alias("config_errors"), ((d(6) + 1) * 60).cast("double").alias("seconds"),
        (1.0 + (d(8) % 3) * 0.75).alias("request_delay"), level.alias("console_level"))
