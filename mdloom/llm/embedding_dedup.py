"""Near-duplicate vectors by random-hyperplane hashing (operator 9).

Vectors of one label and equal components are one class. Each class gets a code
of K sign bits in each of L tables; classes that share a label, a table and a
code are compared exactly by cosine in double precision. K grows with the
logarithm of the classes per label, so buckets stay small, and L follows from
the wanted recall for a pair right at the threshold (``RECALL``); closer pairs
are found more surely. A pair that shares several buckets counts in the first
table only, which the codes of both tell.

A bucket of more than ``BLOCK`` classes is cut by a hash into blocks, and each
pair of blocks is a unit of work, so no task holds an unbounded bucket. Units
send out a count per class and a star per local component, never their pairs.
Components of the stars are found by star contraction.

Results for odd input: vectors that are null, empty, zero, or hold null or
non-finite components, and those with a null label, have no links and are
their own component; vectors of different lengths are never compared; repeated
rows are copies of each other; a null vec_id sorts first in a component; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import load, written
from mdloom.llm.components import connected

RECALL = 0.99
BLOCK = 2048
SEED = 20_240_901


def tables_for(threshold: float, bits: int, recall: float) -> int:
    same = 1 - math.acos(threshold) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(same ** bits))))


def _codes(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            vec = tb.column(batch, "vec")
            sizes = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy()
            out = np.zeros((batch.num_rows, tables), np.int64)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng((SEED, dim)).standard_normal((dim, bits * tables))
                x = flat[starts[rows][:, None] + np.arange(dim)]
                out[rows] = ((x @ planes[dim]) > 0).reshape(len(rows), tables, bits) @ weights
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(out.tolist(), pa.list_(pa.int64()))],
                                             [*batch.schema.names, "codes"])
    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that the links (a, b) reach from each of 0 .. n-1."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _unit(table: int, x: np.ndarray, codes: np.ndarray, side: np.ndarray, cell: tuple[int, int], threshold: float):
    """Links of one unit of work, those found in an earlier table left out."""
    left = np.flatnonzero(side == cell[0])
    right = left if cell[0] == cell[1] else np.flatnonzero(side == cell[1])
    aa, bb = [], []
    for at in range(0, len(left), 256):
        own = left[at:at + 256]
        i, j = np.nonzero(x[own] @ x[right].T >= threshold)
        a, b = own[i], right[j]
        if cell[0] == cell[1]:
            a, b = a[a < b], b[a < b]
        if table and len(a):
            fresh = np.ones(len(a), bool)
            for s in range(0, len(a), 1 << 16):
                cut = slice(s, s + (1 << 16))
                fresh[cut] = ~(codes[a[cut], :table] == codes[b[cut], :table]).any(axis=1)
            a, b = a[fresh], b[fresh]
        aa.append(a)
        bb.append(b)
    return (np.concatenate(aa), np.concatenate(bb)) if aa else (np.empty(0, np.int64), np.empty(0, np.int64))


def _links(threshold: float):
    """Rows sorted by unit: counts of linked vectors per class, and the root of its local component."""
    names = ["class", "links", "root"]

    def solve(keys, rows):
        table, i, j = keys
        ids = np.array([r[0] for r in rows], np.int64)
        size = np.array([r[1] for r in rows], np.int64)
        x = np.array([r[2] for r in rows], np.float64)
        x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True)
        a, b = _unit(table, x, np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), (i, j), threshold)
        if not len(a):
            return None
        links = np.bincount(a, weights=size[b], minlength=len(ids)) + np.bincount(b, weights=size[a], minlength=len(ids))
        touched = np.flatnonzero(links)
        root = _roots(len(ids), a, b)
        return pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(links[touched].astype(np.int64)), pa.array(ids[root[touched]])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            cols = [tb.column(batch, c).to_pylist() for c in ("label", "dim", "table", "code", "i", "j", "class", "copies")]
            vec, codes, side = (tb.column(batch, c) for c in ("vec", "codes", "side"))
            for k, key in enumerate(zip(*cols[:6], strict=True)):
                if key != unit:
                    if len(rows) > 1 and (found := solve((unit[2], unit[4], unit[5]), rows)) is not None:
                        yield found
                    unit, rows = key, []
                rows.append((cols[6][k], cols[7][k], vec[k].values.to_numpy(), codes[k].values.to_numpy(), side[k].as_py()))
        if len(rows) > 1 and (found := solve((unit[2], unit[4], unit[5]), rows)) is not None:
            yield found
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable) and kept (vec_id = component_id) for each row of vec_id, embedding, label."""
    spark = vectors.sparkSession
    fine = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
            .withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull()))
    keyed = written(rows.select("vec_id", F.when(F.col("fine"), F.xxhash64("label", F.transform("vec", lambda x: x + F.lit(0.0)))).alias("class")), "vector-classes")
    classes = written(rows.where("fine").withColumn("class", F.xxhash64("label", F.transform("vec", lambda x: x + F.lit(0.0))))
                      .groupBy("class").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
                                            F.first("vec").alias("vec")).withColumn("dim", F.size("vec")), "vectors")
    sizes = classes.groupBy("label").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    bits = min(24, max(8, math.ceil(math.log2((sizes["most"] or 1) + 1))))
    tables = tables_for(threshold, bits, recall)
    kinds = ", ".join(f"`{c}` {k}" for c, k in classes.dtypes)
    coded = written(classes.mapInArrow(_codes(bits, tables), kinds + ", codes array<long>"), "vector-codes")
    spots = coded.select("class", "label", "dim", F.posexplode("codes").alias("table", "code"))
    bucket = ["label", "dim", "table", "code"]
    many = spots.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    shared = spots.join(many, bucket).select("class", "table", "code", "blocks")
    side = F.pmod(F.xxhash64("class", F.lit("side")), F.col("blocks")).cast("int")
    units = (coded.join(shared, "class").withColumn("side", side)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
             .select(*bucket, "i", "j", "class", "copies", "vec", "codes", "side"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(units.repartition(parts, *bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j", "class")
                    .mapInArrow(_links(threshold), "class long, links long, root long"), "vector-links")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    comps = connected(found.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = (classes.select("class", "least_id", "copies").join(comps.withColumnRenamed("node", "class"), "class", "left")
             .withColumn("component", F.coalesce("component", "class")))
    least = named.groupBy("component").agg(F.min("least_id").alias("least"))
    result = (named.join(least, "component").join(counts, "class", "left")
              .select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id")))
    out = keyed.join(result, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


#: All pairs of a label by exact cosine, for small tables.
BRUTE = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) n USING (vec_id)
JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) c USING (vec_id)
"""
