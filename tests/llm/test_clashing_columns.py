"""Pipeline stages over rows whose other columns have the names that the stages use inside."""

from pyspark.sql import functions as F

import corpus_pipeline as CP

NAMES = ["_id", "_tkey", "_n", "_pass", "_times", "_rows", "_of", "_i", "_t", "_lettered", "lang_pred", "lang_pred_found", "score", "rejected", "row", "worded",
         "named", "nameless", "place", "upto", "mark", "_mark", "_place", "_o", "_null", "_pid", "_mid", "a.b", "Row of", "tkey", "sig", "component", "size", "target"]


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 9 = 0"))            # repeated rows
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    for name, stage in CP.STAGES[:4]:
        plain = sorted(tuple(map(str, r)) for r in stage(spark, docs, "").collect())
        got = stage(spark, wide, "")
        assert got.columns == wide.columns, name
        rows = got.collect()
        at = len(docs.columns)
        assert sorted(tuple(map(str, r[:at])) for r in rows) == plain and plain, name
        assert all(r[at:] == tuple(f"{n}:{r.doc_id}" for n in NAMES) for r in rows), name
