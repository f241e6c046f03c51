"""Sources over the page snapshot and fetch-attempt log."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import urls as U


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def page_scan(spark: SparkSession, sf_dir: str, with_html: bool = False) -> DataFrame:
    """The snapshot as (page_id, url, url_key, host[, html]).

    ``fetch_page(url)`` of a live crawler becomes a scan: the snapshot holds one
    row per fetched URL. Without ``html`` the scan reads two parquet columns."""
    pages = read_table(spark, sf_dir, "pages")
    cols = [F.col("page_id"), F.col("url"), U.normalize_url("url").alias("url_key"),
            U.url_host("url").alias("host")]
    if with_html:
        cols.append(F.col("html"))
    return pages.select(*cols)


def snapshot_lookup(frontier: DataFrame, pages: DataFrame, key: str = "url_key") -> DataFrame:
    """Resolve frontier URLs against the snapshot; a NULL ``html`` is a miss
    (counted as a failed fetch). ``pages`` must be unique on ``key`` (see
    ``operators.urls.dedup_first``)."""
    return frontier.join(pages.select(F.col(key), F.col("page_id"), F.col("html")), key, "left") \
        .withColumn("fetched", F.col("html").isNotNull())


def attempts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch-attempt log from the ``events`` table: ``user_id`` is the URL key,
    ``event_type = 'error'`` a failed attempt, ``ts`` the attempt time."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("url_id"),
                     F.col("ts"), (F.col("event_type") == "error").alias("failed"))
