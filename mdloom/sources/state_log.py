"""Crawl state as a log of deltas.

    base/delta/save=N    rows (run_id, kind, key, value) that changed since save N-1
    base/header/save=N   one row per run that moved: counters, checksum, time

The header of a save is written after its delta; a save without a complete header is
torn and never read. The state at a save is the newest value of each (run_id, kind,
key) up to it, merged on read with partial aggregation, so a hot run or key is no hot
task. ``compact`` writes the merged state once, and later reads start there. Every read
names its schema, so a run called ``007`` keeps its name. The driver lists saves, one
name each, never rows. Only folders whose write ended (``_SUCCESS``) count.

kinds: ``visited`` (value 0), ``failures`` (failed attempts so far) and ``crawled``
(attempt that fetched the URL). Odd input: a save without rows is a save; a null key or
run is a key or run of its own; a base that does not exist yet is an empty state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELTA_DDL = "run_id STRING, kind STRING, key STRING, value BIGINT"
HEADER_DDL = ("run_id STRING, profile_id STRING, config_checksum STRING, processed_count BIGINT, "
              "success_count BIGINT, failed_count BIGINT, timestamp TIMESTAMP")
_TABLES = {"delta": (DELTA_DDL, ["run_id", "kind", "key"]), "header": (HEADER_DDL, ["run_id"])}


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the save folders whose write has ended, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("save=")]
    done = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def saves(spark: SparkSession, base: str) -> list[int]:
    """Complete saves, ascending."""
    return _complete(spark, f"{base}/header")


def write_save(base: str, save: int, delta: DataFrame, header: DataFrame) -> None:
    """One save; written again it replaces itself."""
    for name, df in (("delta", delta), ("header", header)):
        df.select(*_columns(_TABLES[name][0])).write.mode("overwrite").parquet(f"{base}/{name}/save={save:08d}")


def _merged(spark: SparkSession, base: str, name: str, upto: int | None) -> DataFrame:
    ddl, keys = _TABLES[name]
    last = [s for s in saves(spark, base) if upto is None or s <= upto]
    # a compaction is complete when its header part is, which is written last
    start = max((s for s in _complete(spark, f"{base}/compact_header") if last and s <= last[-1]), default=None)
    parts = [(f"{base}/{name}", s) for s in last if start is None or s > start]
    if start is not None:
        parts.append((f"{base}/compact_{name}", start))
    rows = spark.createDataFrame([], ddl + ", save INT")
    for folder in {f for f, _ in parts}:
        paths = [f"{f}/save={s:08d}" for f, s in parts if f == folder]
        rows = rows.unionByName(spark.read.schema(ddl + ", save INT").option("basePath", folder).parquet(*paths))
    values = [c for c in _columns(ddl) if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "save").alias("r"), F.max("save").alias("save")).select(*keys, "r.*", "save")


def read_state(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    """run_id, kind, key, value, save (the one that last set it) at the latest complete save, or at save ``upto``."""
    return _merged(spark, base, "delta", upto)


def read_headers(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    """The newest header of each run."""
    return _merged(spark, base, "header", upto)


def compact(spark: SparkSession, base: str) -> int | None:
    """Write the merged state of the latest complete save; reads then skip the deltas up to it."""
    done = saves(spark, base)
    if not done:
        return None
    for name in ("delta", "header"):
        ddl, _ = _TABLES[name]
        _merged(spark, base, name, done[-1]).select(*_columns(ddl)).write.mode("overwrite").parquet(f"{base}/compact_{name}/save={done[-1]:08d}")
    return done[-1]


def changes(spark: SparkSession, base: str, attempts: DataFrame, before: int | None = None) -> DataFrame:
    """Delta rows of the attempts(run_id, url, attempt_id, failed) made since the last save
    (``before``: since save ``before``): only keys that the attempts touch are looked up."""
    touched = attempts.groupBy("run_id", F.col("url").alias("key")).agg(
        F.count_if("failed").alias("new_failures"), F.min(F.when(~F.col("failed"), F.col("attempt_id"))).alias("fetched"))
    old = read_state(spark, base, before).groupBy("run_id", "key").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("visited", "failures", "crawled")])
    run, key = old["run_id"], old["key"]
    j = touched.join(old, run.eqNullSafe(touched["run_id"]) & key.eqNullSafe(touched["key"]), "left").select(
        touched["run_id"], touched["key"], "new_failures", "fetched", "visited", "failures", "crawled")
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    rows = F.array(F.when(F.col("visited").isNull(), row("visited", F.lit(0))),
                   F.when(F.col("new_failures") > 0, row("failures", F.coalesce("failures", F.lit(0)) + F.col("new_failures"))),
                   F.when(F.col("crawled").isNull() & F.col("fetched").isNotNull(), row("crawled", F.col("fetched"))))
    return j.select("run_id", "key", F.explode(F.array_compact(rows)).alias("r")).select("run_id", "r.kind", "key", "r.value")


def moved_headers(spark: SparkSession, base: str, attempts: DataFrame, profiles: DataFrame, before: int | None = None) -> DataFrame:
    """Headers of the runs that made the attempts(run_id, failed, ts): counters go on from the
    last header; profiles(run_id, profile_id, config_checksum) name what they ran with."""
    new = attempts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("f"), F.max("ts").cast("timestamp").alias("timestamp"))
    old = read_headers(spark, base, before).select("run_id", "processed_count", "success_count", "failed_count")
    plus = lambda c, d: (F.coalesce(c, F.lit(0)) + d).alias(c)
    j = new.join(old, new["run_id"].eqNullSafe(old["run_id"]), "left").drop(old["run_id"])
    j = j.join(profiles, j["run_id"].eqNullSafe(profiles["run_id"]), "left").drop(profiles["run_id"])
    return j.select("run_id", "profile_id", "config_checksum", plus("processed_count", F.col("n")), plus("success_count", F.col("n") - F.col("f")),
                    plus("failed_count", F.col("f")), "timestamp")
