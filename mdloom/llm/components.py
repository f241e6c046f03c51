"""Connected components of a link table by star contraction.

Each round is two relational steps. Large star: every node hands its larger
neighbours to its smallest neighbour. Small star: every node hands its smaller
neighbours and itself to the smallest of them. Both keep the components and
turn the graph into one star per component around its smallest node, in a
number of rounds that grows with the logarithm of the graph's size. Rounds are
written to the shared folder; nothing is gathered on the driver but a count and
a checksum. Minima are aggregated on the map side, so a hub with many links is
no single task's burden; the joins back on the hub are skew-split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component): for each node of a link the smallest node that links reach."""
    edges = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                    .where(F.col("a") > F.col("b")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = written(large, "large-star")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(smallest, "a").where(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        edges = written(small, "small-star")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
