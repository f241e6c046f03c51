"""Error events as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: error taxonomy --------------------------------------------
ERROR_TYPES = ["network_error", "content_extraction_error", "file_system_error", "config_error"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
# severity -> log level, processing continues?
SEVERITY_POLICY = {"CRITICAL": ("critical", False), "HIGH": ("error", False),
                   "MEDIUM": ("warning", True), "LOW": ("info", True)}
# error type -> retried?
TYPE_RETRY = {"network_error": True, "content_extraction_error": False,
              "file_system_error": True, "config_error": False}
# -----------------------------------------------------------------------------

ERROR_COLUMNS = ["source", "error_type", "severity", "url", "file_path", "message"]


def error_types(spark: SparkSession) -> DataFrame:
    """The 4-row error-type dimension (broadcast-sized by construction)."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(ERROR_TYPES)], "error_type string, type_rank int")


def union_errors(*parts: DataFrame) -> DataFrame:
    """G1: errors from every component (crawler, converter, main) in one table."""
    out = None
    for p in parts:
        p = p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("string").alias(c) for c in ERROR_COLUMNS])
        out = p if out is None else out.unionByName(p)
    return out


def error_summary(spark: SparkSession, errors: DataFrame) -> DataFrame:
    """Count per error type, zero-filled over all four types."""
    counts = errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    dim = F.broadcast(error_types(spark))
    return dim.join(counts, "error_type", "left").select(
        "error_type", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def error_policy(errors: DataFrame) -> DataFrame:
    """Log level, continue flag and retry flag per error row."""
    lvl = F.lit("info")
    cont = F.lit(None).cast("boolean")
    for sev, (level, go_on) in SEVERITY_POLICY.items():
        lvl = F.when(F.col("severity") == sev, F.lit(level)).otherwise(lvl)
        cont = F.when(F.col("severity") == sev, F.lit(go_on)).otherwise(cont)
    retry = F.lit(False)
    for t, r in TYPE_RETRY.items():
        retry = F.when(F.col("error_type") == t, F.lit(r)).otherwise(retry)
    return errors.withColumn("log_level", lvl).withColumn("continue_run", F.coalesce(cont, F.lit(False))) \
        .withColumn("retry", retry)
