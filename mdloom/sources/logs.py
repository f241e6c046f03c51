"""Log analysis (S4, F7, P20, P21, A8, W9): the run logs are text lines
``asctime - logger - LEVEL - message | k=v | k=v``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: line layout, levels and their ranks ----------------------
LINE_RX = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:,\d+)? - (.+?) - (DEBUG|INFO|WARNING|ERROR|CRITICAL) - (.*)$"
LEVEL_RANK = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
DEFAULT_LEVEL = "INFO"
CONTEXT_SEP = " | "
# -----------------------------------------------------------------------------


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Text files → one row per line with the source file and line number."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value"))


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Split lines into ts, logger, level, message, ctx; lines without the prefix
    (stack traces) keep NULL fields and ``continuation = true``."""
    v = F.col(col)
    m = v.rlike(LINE_RX)
    msg_full = F.regexp_extract(v, LINE_RX, 4)
    return lines.select(
        "*",
        F.when(m, F.to_timestamp(F.regexp_extract(v, LINE_RX, 1), "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.when(m, F.regexp_extract(v, LINE_RX, 2)).alias("logger"),
        F.when(m, F.regexp_extract(v, LINE_RX, 3)).alias("level"),
        F.when(m, context_message(msg_full)).alias("message"),
        F.when(m, context_map(msg_full)).alias("ctx"),
        (~m).alias("continuation"))


def context_message(text) -> Column:
    """P20: the message part before the first `` | key=value``."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(t, r" \| [^|=]+=.*$", "")


def context_map(text) -> Column:
    """P20: ``k=v`` pairs after the message as MAP<STRING,STRING>."""
    t = F.col(text) if isinstance(text, str) else text
    tail = F.regexp_extract(t, r" \| ([^|=]+=.*)$", 1)
    pairs = F.filter(F.split(tail, r" \| "), lambda p: F.contains(p, F.lit("=")))
    keys = F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)))
    # of a repeated key the last entry holds
    vals = F.transform(keys, lambda k: F.regexp_extract(
        F.element_at(F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == k), -1), r"^[^=]*=(.*)$", 1))
    return F.when(tail == "", F.create_map().cast("map<string,string>")) \
        .otherwise(F.map_from_arrays(keys, vals))


def level_rank(level) -> Column:
    """Numeric rank of a level name; unknown names count as INFO."""
    lv = F.upper(F.col(level) if isinstance(level, str) else level)
    out = F.lit(LEVEL_RANK[DEFAULT_LEVEL])
    for name, r in LEVEL_RANK.items():
        out = F.when(lv == name, F.lit(r)).otherwise(out)
    return out


def log_errors(parsed: DataFrame, url_substring: str | None = None) -> DataFrame:
    """ERROR and CRITICAL lines, optionally only those mentioning a URL."""
    out = parsed.where(F.col("level").isin("ERROR", "CRITICAL"))
    if url_substring:
        out = out.where(F.contains(F.col("value"), F.lit(url_substring)))
    return out


def log_stats(parsed: DataFrame) -> DataFrame:
    """Lines per logger and level."""
    return parsed.where(~F.col("continuation")).groupBy("logger", "level").agg(F.count(F.lit(1)).alias("n"))


def log_tail(parsed: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` lines (top-n is the feature: each partition keeps n)."""
    return parsed.where(~F.col("continuation")).orderBy(F.desc("ts"), F.desc("value")).limit(n)
