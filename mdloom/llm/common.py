"""Reading tables and writing intermediate tables to the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.session import scratch_path, ship_package

#: A word, as the text operators of this package count them.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: lineage is
    cut, and a lost executor only repeats reads. ``by`` makes folders of a column."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("error")
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct named row, apart from the names that an operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def text_key() -> Column:
    """64-bit hash of the text (null: of the empty text), made by the JVM."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def crc_mod(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
