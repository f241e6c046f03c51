"""Crawl state snapshots.

A snapshot is a table, not a JSON file: ``visited``/``crawled`` URL lists and
failure counters are stored as rows of child tables keyed by ``run_id``, so a
snapshot of a million-page crawl is written in parallel. The write goes to a
new directory per snapshot; the commit protocol makes it appear atomically and
the latest complete snapshot per run wins on read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: per-field defaults when a snapshot lacks a field ----------
STATE_DEFAULTS = {"processed_count": 0, "success_count": 0, "failed_count": 0}
# -----------------------------------------------------------------------------


def write_snapshot(base: str, run_id: str, snapshot_no: int, header: DataFrame,
                   visited: DataFrame, failures: DataFrame, crawled: DataFrame) -> str:
    """header(run_id, profile_id, start_url, processed_count, success_count,
    failed_count, timestamp, config_checksum), visited(url), failures(url,
    failures), crawled(seq, url) → ``base/<part>/run_id=<id>/snap=<n>``; the header
    is written last, so a snapshot without a header is incomplete and ignored."""
    # run_id and snap live in the path (partition columns)
    for name, df in (("visited", visited), ("failures", failures), ("crawled", crawled), ("header", header)):
        df.drop("run_id").write.mode("overwrite").parquet(
            os.path.join(base, name, f"run_id={run_id}", f"snap={snapshot_no}"))
    return base


def read_latest(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The newest complete snapshot per run, with per-field defaults."""
    headers = spark.read.parquet(os.path.join(base, "header"))
    latest = headers.groupBy("run_id").agg(F.max("snap").alias("snap"))
    h = headers.join(latest, ["run_id", "snap"])
    for k, d in STATE_DEFAULTS.items():
        h = h.withColumn(k, F.coalesce(F.col(k), F.lit(d)))
    out = {"header": h}
    for part in ("visited", "failures", "crawled"):
        t = spark.read.parquet(os.path.join(base, part))
        out[part] = t.join(latest, ["run_id", "snap"], "left_semi")
    return out
