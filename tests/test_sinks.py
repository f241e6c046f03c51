"""Markdown sink (S5) and the one-pass corpus job."""

import tempfile

from pyspark.sql import functions as F

from mdloom.sources import sinks as SK

from conftest import SF_SMALL


def test_build_corpus_small(spark):
    out = tempfile.mkdtemp(prefix="mdloom-corpus-", dir="/tmp")
    paths = SK.build_corpus(spark, SF_SMALL, out)
    docs = spark.read.parquet(paths["documents"])
    md = spark.read.parquet(paths["markdown"])
    assert docs.count() == 50
    assert spark.read.parquet(paths["links"]).count() == 281          # SURVEY §5 anchor at sf0.001
    # one file row per distinct (host, md_path); host is the partition column
    want = docs.select("host", "md_path").distinct().count()
    assert md.count() == want and "host" in md.columns
    assert md.where(F.col("markdown").isNull()).count() == 0


def test_sink_refuses_dotdot_and_last_write_wins(spark):
    out = tempfile.mkdtemp(prefix="mdloom-md-", dir="/tmp")
    docs = spark.createDataFrame([(1, "http://h/a", "h", "a.md", "one"), (2, "http://h/a/", "h", "a.md", "two"),
                                  (3, "http://h/../x", "h", "../x.md", "bad")],
                                 "page_id long, url string, host string, md_path string, markdown string")
    refused = SK.write_markdown(docs, out).collect()
    assert [r.page_id for r in refused] == [3]
    rows = spark.read.parquet(out).collect()
    assert [(r.md_path, r.markdown) for r in rows] == [("a.md", "two")]
