"""Markdown corpus sink (S5) and the one-pass corpus job.

The reference writes one file per page under ``base_dir/md_path``. Here the
corpus is a table partitioned by host with the path kept as a column: one
parquet file per (task, host) instead of millions of tiny files, and an
overwrite is atomic through the commit protocol. Paths with ``..`` segments
(Q15) are refused and reported instead of written.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.plans import corpus as C

# --- fixed parameters ---------------------------------------------------------
MAX_RECORDS_PER_FILE = 50_000
# -----------------------------------------------------------------------------


def unsafe_path(col: str = "md_path"):
    return F.col(col).rlike(r"(^|/)\.\.(/|\.md$|$)")


def write_markdown(docs: DataFrame, out: str) -> DataFrame:
    """Write (host, md_path, markdown, page_id, url) partitioned by host; last
    write wins on equal (host, md_path) in crawl order (W3). Returns the refused rows."""
    ok = docs.where(F.col("markdown").isNotNull() & ~unsafe_path())
    winners = ok.groupBy("host", "md_path").agg(
        F.max_by(F.struct("page_id", "url", "markdown"), "page_id").alias("w"))
    (winners.select("host", "md_path", "w.page_id", "w.url", "w.markdown")
     .sortWithinPartitions("host")
     .write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .partitionBy("host").parquet(out))
    return docs.where(unsafe_path()).select("page_id", "url", "md_path")


def build_corpus(spark: SparkSession, sf_dir: str, out_dir: str) -> dict[str, str]:
    """Parse every page once (written as a table), then derive documents, links
    and the Markdown corpus from it. Returns the written table paths."""
    parsed_path = os.path.join(out_dir, "parsed")
    C.parsed_pages(spark, sf_dir).write.mode("overwrite").parquet(parsed_path)
    parsed = spark.read.parquet(parsed_path)
    docs = C.documents(parsed).select("page_id", "url", "url_key", "host", "md_path", "markdown",
                                      "status", "source", "error_severity")
    docs_path = os.path.join(out_dir, "documents")
    docs.write.mode("overwrite").parquet(docs_path)
    links_path = os.path.join(out_dir, "links")
    C.links(parsed).write.mode("overwrite").parquet(links_path)
    md_path = os.path.join(out_dir, "markdown")
    refused = write_markdown(spark.read.parquet(docs_path), md_path)
    refused_path = os.path.join(out_dir, "refused")
    refused.write.mode("overwrite").parquet(refused_path)
    return {"parsed": parsed_path, "documents": docs_path, "links": links_path,
            "markdown": md_path, "refused": refused_path}
