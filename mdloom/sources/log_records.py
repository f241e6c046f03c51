"""Log records over whole files (S4, F7): a record is a line with the log prefix and
the lines without one that follow it (stack traces).

A large file is read in blocks, so a trace may go on in the next block. Lines are
placed by (file, block, order within the block); the head of a block's first lines is
carried over from the blocks before it by a table of one row per block. A task holds
one block, never a whole file. Results for odd input: lines before the first head of a
file belong to no record (``head_line`` NULL); an empty file gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mdloom.sources.logs import LINE_RX, context_map, context_message

ERROR_LEVELS = ["ERROR", "CRITICAL"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files → file, block (offset of the split), at (order in the split), value."""
    t = spark.read.text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), "value")


def with_heads(lines: DataFrame) -> DataFrame:
    """``read_lines`` rows → file, line_no (from 1), value, head_line and head (number and
    text of the line that opens the record)."""
    in_block = Window.partitionBy("file", "block").orderBy("at")
    local = lines.select("file", "block", "value", F.row_number().over(in_block).cast("long").alias("n"),
                         F.last(F.when(F.col("value").rlike(LINE_RX), F.struct("at", "value")), ignorenulls=True).over(in_block).alias("open"),
                         "at")
    # the head's own number within its block: the line at which it stands
    local = local.withColumn("head_n", F.last(F.when(F.col("at") == F.col("open.at"), F.col("n")), ignorenulls=True).over(in_block))
    blocks = local.groupBy("file", "block").agg(
        F.max("n").alias("lines"), F.max("head_n").alias("head_n"), F.max_by("open.value", "n").alias("head"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    last_head = F.when(F.col("head_n").isNotNull(), F.struct((F.col("offset") + F.col("head_n")).alias("line"), F.col("head").alias("text")))
    carried = blocks.select("file", "block", "offset", F.last(last_head, ignorenulls=True).over(before).alias("carried"))
    j = local.join(carried, ["file", "block"])
    return j.select("file", (F.col("offset") + F.col("n")).alias("line_no"), "value",
                    F.coalesce(F.col("offset") + F.col("head_n"), F.col("carried.line")).alias("head_line"),
                    F.coalesce(F.col("open.value"), F.col("carried.text")).alias("head"))


def error_lines(lines: DataFrame, url_substring: str | None = None) -> DataFrame:
    """all lines of the records at ERROR or CRITICAL; with ``url_substring`` only of
    records of which some line holds it. Adds level, message and ctx of the head."""
    head = F.regexp_extract("head", LINE_RX, 4)
    out = lines.withColumn("level", F.regexp_extract("head", LINE_RX, 3)).where(F.col("level").isin(ERROR_LEVELS))
    if url_substring:
        hit = out.where(F.contains("value", F.lit(url_substring))).select("file", "head_line").distinct()
        out = out.join(hit, ["file", "head_line"], "left_semi")
    return out.select("*", context_message(head).alias("message"), context_map(head).alias("ctx"))


def error_records(errors: DataFrame) -> DataFrame:
    """One row per record of ``error_lines``: its head, number of lines and last line
    (the exception of a trace); a trace of any length takes constant memory."""
    return errors.groupBy("file", "head_line").agg(
        F.first("level").alias("level"), F.first("head").alias("head"), F.first("ctx").alias("ctx"),
        F.count(F.lit(1)).alias("n_lines"), F.max_by("value", "line_no").alias("last_line"))
