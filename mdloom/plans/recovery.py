"""State saves of crawls over the attempt log, their restore and the resume gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.operators import profiles as PR
from mdloom.session import scratch_path
from mdloom.sources import state_log as SL
from mdloom.sources.pages import attempts_from_events, read_table

#: The attempts' time is cut into as many even parts, a save after each; the last save is torn (its header is missing).
SAVES = 5
#: Crawls that run side by side.
RUNS = 16


def run_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, url, attempt_id, failed, ts, save: the URL's id picks the run, time the save."""
    a = attempts_from_events(spark, sf_dir)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = a.agg(F.min(us)).scalar(), a.agg(F.max(us)).scalar()
    save = F.least(F.lit(SAVES - 1), F.call_function("div", (us - lo) * SAVES, hi - lo + 1)).cast("int")
    return a.select(F.lpad((F.col("url_id") % RUNS).cast("string"), 3, "0").alias("run_id"), F.col("url_id").cast("string").alias("url"),
                    "attempt_id", "failed", "ts", save.alias("save"))


def _write_saves(spark: SparkSession, sf_dir: str) -> str:
    base = scratch_path(spark, "state")
    attempts = run_attempts(spark, sf_dir)
    for n in range(SAVES):
        part = attempts.where(F.col("save") == n)
        profiles = part.select("run_id").distinct().select("run_id", F.concat(F.lit("p"), "run_id").alias("profile_id"), F.md5("run_id").alias("config_checksum"))
        delta, header = SL.changes(spark, base, part), SL.moved_headers(spark, base, part, profiles)
        if n < SAVES - 1:
            SL.write_save(base, n, delta, header)
        else:  # torn: the writer was lost before the header
            delta.write.mode("overwrite").parquet(f"{base}/delta/save={n:08d}")
        if n == SAVES // 2:
            SL.compact(spark, base)
    return base


def q_state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every complete save, as its delta holds them."""
    base = _write_saves(spark, sf_dir)
    return spark.read.schema(SL.DELTA_DDL + ", save INT").parquet(f"{base}/delta").where(F.col("save").isin(SL.saves(spark, base)))


def q_state_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at the latest complete save, read over the compaction, and the counters as rows of key ''."""
    base = _write_saves(spark, sf_dir)
    counters = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(f"{c}_count").alias("value")) for c in ("processed", "success", "failed")])
    heads = SL.read_headers(spark, base).select("run_id", F.explode(counters).alias("c")).select("run_id", "c.kind", F.lit("").alias("key"), "c.value")
    return SL.read_state(spark, base).select("run_id", "kind", "key", "value").unionByName(heads)


def _profiles(spark: SparkSession, sf_dir: str, now: bool) -> DataFrame:
    """A profile per page. By now every third has another content folder (a change that counts) and every seventh another
    delay (one that does not); recovery is on, off, null or not mentioned."""
    pid = F.col("page_id")
    recovery = F.get(F.array(F.lit(', "recovery": {"enable_recovery": true}'), F.lit(', "recovery": {"enable_recovery": false}'),
                             F.lit(', "recovery": {"enable_recovery": null}'), F.lit("")), (pid % 4).cast("int"))
    folder = F.when(F.lit(now) & (pid % 3 == 0), F.lit("new")).otherwise(F.lit("old"))
    delay = F.when(F.lit(now) & (pid % 7 == 0), F.lit("2.5")).otherwise(F.lit("1.5"))
    text = F.concat(F.lit('{"target_site": {"start_url": "https://a.org/", "allowed_domain": "https://a.org/"}, "output": {"base_dir": "'), folder,
                    F.lit('"}, "execution": {"request_delay": '), delay, F.lit("}"), recovery, F.lit("}"))
    raw = read_table(spark, sf_dir, "pages").select(pid.cast("string").alias("profile_id"), text.alias("profile_json"))
    return PR.merge_profiles(PR.parse_profiles(raw))


def q_resume_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 over saved headers: a run per page that made attempts, saved with the profile of its time, in two saves."""
    base = scratch_path(spark, "resume")
    attempts = attempts_from_events(spark, sf_dir).select(F.lpad(F.col("url_id").cast("string"), 9, "0").alias("run_id"), "attempt_id", "failed", "ts",
                                                          F.col("url_id").cast("string").alias("url"))
    old = PR.profile_checksum(_profiles(spark, sf_dir, now=False)).withColumn("run_id", F.lpad("profile_id", 9, "0"))
    for n in range(2):
        part = attempts.where(F.col("attempt_id") % 2 == n)
        SL.write_save(base, n, SL.changes(spark, base, part), SL.moved_headers(spark, base, part, old))
    heads = SL.read_headers(spark, base).where(F.col("profile_id").isNotNull())
    gate = PR.resume_gate(_profiles(spark, sf_dir, now=True), heads)
    return gate.withColumn("page_id", F.col("profile_id").cast("long")).drop("profile_id")
