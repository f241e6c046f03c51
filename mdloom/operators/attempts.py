"""Fetch attempts: retry policy, auto-skip and failure roll-ups
(P13-P15, F5, W5, W7, A1, A4, A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdloom.operators.order import ranked

# --- fixed values: retry defaults of a site profile --------------------------
DEFAULT_MAX_RETRIES = 3
DEFAULT_BACKOFF_FACTOR = 2.0
DEFAULT_INITIAL_DELAY = 1.0
DEFAULT_MAX_DELAY = 60.0
DEFAULT_RETRY_STATUS = [429, 500, 502, 503, 504]
DEFAULT_SKIP_AFTER = 5
# fetch outcome classes: outcome -> (severity, retry?) ; 'http' depends on status
OUTCOME_RULES = {
    "timeout": ("MEDIUM", True),
    "connection": ("MEDIUM", True),
    "request": ("MEDIUM", True),
    "unexpected": ("HIGH", False),
}
# -----------------------------------------------------------------------------


def backoff_delay(k, initial=DEFAULT_INITIAL_DELAY, factor=DEFAULT_BACKOFF_FACTOR,
                  max_delay=DEFAULT_MAX_DELAY) -> Column:
    """Delay before retry number ``k`` (0-based): min(initial * factor^k, max)."""
    kk = F.col(k) if isinstance(k, str) else k
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(lit(initial) * F.pow(lit(factor), kk.cast("double")), lit(max_delay))


def attempts_allowed(max_retries) -> Column:
    """Q3: ``max_retries`` counts total attempts, at least one."""
    m = F.col(max_retries) if isinstance(max_retries, str) else F.lit(max_retries)
    return F.greatest(F.lit(1), m)


def classify_fetch(outcome, status, retry_codes: list[int] | Column | None = None) -> Column:
    """struct(error_type, severity, retry) of one attempt.
    ``ok`` → NULLs; timeout/connection/request → MEDIUM, retried; HTTP status in
    the retry list → MEDIUM, retried, else LOW, not retried; anything else → HIGH."""
    o = F.col(outcome) if isinstance(outcome, str) else outcome
    s = F.col(status) if isinstance(status, str) else status
    codes = retry_codes if retry_codes is not None else DEFAULT_RETRY_STATUS
    in_list = F.array_contains(codes, s) if isinstance(codes, Column) else s.isin(codes)
    in_list = F.coalesce(in_list, F.lit(False))
    sev = F.when(o == "ok", F.lit(None).cast("string"))
    retry = F.when(o == "ok", F.lit(None).cast("boolean"))
    for name, (sv, rt) in OUTCOME_RULES.items():
        if name == "unexpected":
            continue
        sev = sev.when(o == name, F.lit(sv))
        retry = retry.when(o == name, F.lit(rt))
    sev = sev.when(o == "http", F.when(in_list, F.lit("MEDIUM")).otherwise(F.lit("LOW"))).otherwise(F.lit("HIGH"))
    retry = retry.when(o == "http", in_list).otherwise(F.lit(False))
    etype = F.when(o == "ok", F.lit(None).cast("string")).otherwise(F.lit("network_error"))
    return F.struct(etype.alias("error_type"), sev.alias("severity"), retry.alias("retry"))


def auto_skip(attempts: DataFrame, url_col: str = "url_id", order: list[str] | None = None,
              skip_after: int = DEFAULT_SKIP_AFTER) -> DataFrame:
    """Per attempt its number within the URL and the failures before it
    (cumulative, never reset by a success, Q4); ``skipped`` when those reach
    ``skip_after``. Hot URLs are split across partitions (``ranked``)."""
    order = order or ["ts", "attempt_id"]
    df = attempts.withColumn("_f", F.col("failed").cast("long"))
    r = ranked(df, [url_col], order, seq_col="attempt_no", sum_cols={"_fails": "_f"})
    return (r.withColumn("prior_failures", (F.col("_fails") - F.col("_f")).cast("long"))
            .withColumn("skipped", F.col("prior_failures") >= skip_after)
            .drop("_f", "_fails"))


def failed_urls(attempts: DataFrame, url_col: str = "url_id") -> DataFrame:
    """A4: failures and attempts per URL (partial aggregation before the shuffle)."""
    return attempts.groupBy(url_col).agg(
        F.count_if(F.col("failed")).alias("failures"), F.count(F.lit(1)).alias("attempts"))


def top_failures(per_url: DataFrame, k: int = 10, url_col: str = "url_id") -> DataFrame:
    """The k most-failing URLs (ties by URL), numbered. Top-k is the feature:
    each partition keeps its k best before the final merge."""
    top = per_url.where(F.col("failures") > 0).orderBy(F.desc("failures"), F.col(url_col)).limit(k)
    return top.select(url_col, "failures",
                      F.concat(F.col(url_col).cast("string"), F.lit(": "), F.col("failures").cast("string"),
                               F.lit(" failures")).alias("label"))


def crawl_stats(attempts: DataFrame, url_col: str = "url_id", skip_after: int = DEFAULT_SKIP_AFTER) -> DataFrame:
    """A1/A5: attempts, failed attempts (Q6: attempts, not pages), URLs, and URLs that
    reached the auto-skip threshold."""
    per = failed_urls(attempts, url_col)
    return per.agg(
        F.sum("attempts").alias("total_attempts"),
        F.sum("failures").alias("total_failed"),
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(F.col("failures") < F.col("attempts")).alias("urls_with_success"),
        F.count_if(F.col("failures") >= skip_after).alias("auto_skipped"))
