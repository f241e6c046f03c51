"""State of a stream by key, in hash buckets of written tables.

    base/batch=N/bucket=B    what micro-batch N adds: keys and amounts
    base/fold=N/bucket=B     the sums of all batches below N

A micro-batch reads the buckets that its own keys fall into and no others; a partition
filter on ``bucket`` prunes the rest at planning time. Amounts add up, so a key's state
is a sum with partial aggregation before the shuffle and a hot key is no hot task,
unlike a stateful operator, which takes all rows of a key in one. A replayed batch reads
only what lies below its id and writes its own folder again, so restarts count once.
Every ``fold_every`` batches the sums are folded, which bounds the folders to read. The
driver holds at most ``buckets`` bucket numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedState:
    """``key``: column name; ``amounts``: names of the long columns that add up."""

    def __init__(self, base: str, key: str, amounts: list[str], buckets: int = 256, fold_every: int = 32):
        self.base, self.key, self.amounts, self.buckets, self.fold_every = base, key, amounts, buckets, fold_every

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, spark: SparkSession, kind: str) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{kind}=")]
        return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def below(self, spark: SparkSession, batch_id: int, schema: str, touched: list[int] | None = None) -> DataFrame:
        """Key and sums over the batches below ``batch_id``; with ``touched`` only of those buckets. ``schema`` is the DDL of the key."""
        fold = max((n for n in self._folders(spark, "fold") if n <= batch_id), default=None)
        paths = [f"{self.base}/batch={n:010d}" for n in self._folders(spark, "batch") if n < batch_id and (fold is None or n >= fold)]
        paths += [] if fold is None else [f"{self.base}/fold={fold:010d}"]
        ddl = ", ".join([schema, *[f"{a} BIGINT" for a in self.amounts]])
        rows = spark.createDataFrame([], ddl)
        for p in paths:
            part = spark.read.schema(ddl + ", bucket INT").parquet(p)
            part = part if touched is None else part.where(F.col("bucket").isin(touched))
            rows = rows.unionByName(part.drop("bucket"))
        return rows.groupBy(self.key).agg(*[F.sum(a).alias(a) for a in self.amounts])

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch's keys."""
        return [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]

    def write(self, batch_id: int, rows: DataFrame, schema: str) -> None:
        """Add a batch's rows (key, amounts), one per key, and fold when it is time."""
        self._write(rows, f"batch={batch_id:010d}")
        if batch_id and batch_id % self.fold_every == 0:
            self._write(self.below(rows.sparkSession, batch_id, schema), f"fold={batch_id:010d}")

    def _write(self, rows: DataFrame, name: str) -> None:
        out = rows.select(self.key, *self.amounts, self.bucket().alias("bucket"))
        # a bucket is one file
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/{name}")
