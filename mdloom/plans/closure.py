"""Crawl closure over bucketed tables, by site and page, with the order of the pages.

Nodes are keyed by site columns and a node id, so several sites (profiles) crawl one
snapshot side by side and a page may be reached by more than one of them. Edges and
visited nodes are tables bucketed alike by that key: a level joins its frontier to the edges without
a shuffle, shuffles only what it has found, and looks that up among the visited nodes bucket by bucket.
The visited table grows by a file per bucket and level; it is never unioned, reshuffled or rewritten, and
the files of other levels are passed over by their column statistics where only the frontier is read.

Order (G5): within a level pages stand by (priority, place of the least parent, position of the
link there); places go on from level to level, so ties fall to the page discovered first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mdloom.operators.order import ranked
from mdloom.session import ensure_checkpoint_dir, scratch_path


class _Bucketed:
    """A table under the shared scratch folder, bucketed by ``keys``; the catalog entry goes with ``close``."""

    def __init__(self, spark, name: str, keys: list[str], buckets: int):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.name = f"mdloom_{name}_{uuid.uuid4().hex[:12]}"
        self.path = scratch_path(spark, name)

    def add(self, rows: DataFrame) -> int:
        """Append rows; their number is counted as they are written."""
        seen = Observation()
        rows = rows.repartition(self.buckets, *self.keys).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, *self.keys).saveAsTable(self.name)
        return seen.get["n"]

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # the files stay


def reach(edges: DataFrame, seeds: DataFrame, by: list[str] | None = None, ordered: bool = False, max_levels: int | None = None) -> DataFrame:
    """(by..., node, depth[, seq]): every node reachable from ``seeds`` (by..., node) along ``edges``
    (by..., src, dst[, priority, pos]), of the same site throughout. Seeds are never filtered (Q11);
    out-of-scope edges are left out beforehand. ``seq`` is the place in the site's crawl order, from 1."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    by = by or []
    key = [*by, "node"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ways = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if ordered:  # of several links between two pages the best one counts
        ways = ways.groupBy(*by, "src", "dst").agg(F.min(F.struct("priority", "pos")).alias("w")).select(*by, F.col("src").alias("node"), "dst", "w.priority", "w.pos")
    else:
        ways = ways.select(*by, F.col("src").alias("node"), "dst").distinct()
    table, visited = _Bucketed(spark, "edges", key, buckets), _Bucketed(spark, "visited", key, buckets)
    table.add(ways)
    first = seeds.select(*key).distinct()
    if ordered:
        first = _placed(first.withColumns({"priority": F.lit(0), "from": F.lit(0).cast("long"), "pos": F.lit(0)}), by, None)
    n_new = visited.add(first.withColumn("depth", F.lit(0)))
    cols = [*key, *(["seq"] if ordered else [])]
    depth = 0
    while n_new and (max_levels is None or depth < max_levels):
        now = visited.read()
        depth += 1
        front = now.where(F.col("depth") == depth - 1).select(*cols)
        found = front.join(table.read(), key)
        if ordered:
            found = found.groupBy(*by, F.col("dst").alias("node")).agg(F.min(F.struct("priority", F.col("seq").alias("from"), "pos")).alias("w")).select(*key, "w.*")
        else:
            found = found.select(*by, F.col("dst").alias("node")).distinct()
        new = found.join(now.select(*key), key, "left_anti")
        if ordered:
            new = _placed(new, by, now)
        n_new = visited.add(new.withColumn("depth", F.lit(depth)))
    schema = visited.read().select(*cols, "depth").schema
    out = spark.read.schema(schema).parquet(visited.path)
    table.close()
    visited.close()
    return out


def _placed(new: DataFrame, by: list[str], before: DataFrame | None) -> DataFrame:
    """Rows of a level with their place ``seq``, going on from the number of the site's nodes in earlier levels."""
    sites = by or ["one"]
    rows = new if by else new.withColumn("one", F.lit(1))
    rows = ranked(rows, sites, ["priority", "from", "pos", "node"], seq_col="seq")
    if before is not None:
        last = (before if by else before.withColumn("one", F.lit(1))).groupBy(*[F.col(c).alias(f"of_{c}") for c in sites]).agg(F.count(F.lit(1)).alias("done"))
        same = [F.col(c) == F.col(f"of_{c}") for c in sites]
        rows = rows.join(last, same).withColumn("seq", F.col("seq") + F.col("done"))
    return rows.select(*by, "node", "seq")
