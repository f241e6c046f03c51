"""Prefix trie of rebuilt conversations by composable monoid fingerprints (operator 12).

Every conversation c is rebuilt from the head of another, the first h turns of
``base``, and its own turns after the first h. Texts are never put together: a
sequence of turns is the monoid element (length, hash product), where

    (n, x) * (m, y) = (n + m, x + B**n * y)  modulo three primes below 2**31,

so the fingerprint of a prefix of a rebuilt conversation is the product of a head
prefix of its base and of a run of its own turns, both read off running sums over the
stored turns. A stored turn is a reference (conv_id, position) with a 256-bit digest of its role and text.

1. Turns are numbered in each conversation over range partitions, and running
   sums of digest * B**position are kept with them, so a long conversation spans many tasks.
2. Heads (at most 8 turns) are joined to the conversations; each prefix of each rebuilt
   conversation becomes one row: conversation, depth, fingerprint, its parent's, digest of its last turn.
3. Prefixes of equal depth and fingerprint are a node. Equality is verified: all rows of a
   node must have the same digest of the last turn and the same parent fingerprint; by induction over the
   depth all their turns are equal then. If any node fails, all fingerprints are made anew with other bases.
4. A node is named by its smallest member r. The nodes that r names are the last part of its path. So the sum over a
   node's subtree is that over r's own part from there on, and over the whole own parts of all other
   members, which all begin deeper. Two aggregations and one running sum give every subtree; nothing goes level by level.
5. The ids that end in a node are joined to short strings by range partitions; one pass over a node's
   strings hashes them in order, without holding them.

Results for odd input: rows without a conv_id belong to no conversation and make no node; null roles and texts
are empty; turns of one number (null ones come first) stand in the order of role, then of the first 64
characters of the text, then of the digest; repeated rows are turns of their own; base is c - c % 5 with the remainder's sign that
of c, as in SQL; other columns are ignored; an empty table has no conversation and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import load, written
from mdloom.operators.order import ranked

#: Primes below 2**31: the product of two residues fits a long.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
MOST_HEAD = 8
HEADS = 9
FAMILY = 5
#: Bytes of one string of joined ids.
PIECE = 1 << 13
DIGEST = ["d1", "d2", "d3", "d4"]
SUMS = ["u1", "u2", "u3"]
TERMS = ["t1", "t2", "t3"]


def bases(attempt: int) -> list[int]:
    """One base per prime, from the digest of its place and the attempt."""
    return [2 + int.from_bytes(hashlib.sha256(f"{attempt}:{i}".encode()).digest()[:8], "big") % (p - 3) for i, p in enumerate(PRIMES)]


def _digest(role: Column, text: Column) -> list[Column]:
    """SHA-256 of role and text as four longs; the length of the role keeps the two apart."""
    code = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return [F.conv(F.substring(code, 1 + 16 * i, 16), 16, -10).cast("long").alias(c) for i, c in enumerate(DIGEST)]


def stored(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, d1..d4, bytes): the turns of each conversation in order, from position 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = (conversations.where(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("front"),
                     *_digest(role, text), F.octet_length(text).cast("long").alias("bytes")))
    order = [F.col("turn").asc_nulls_first(), "role", "front", *DIGEST]
    return ranked(turns, ["conv_id"], order, seq_col="pos").select("conv_id", "pos", *DIGEST, "bytes")


def _power(base: int, exponent: np.ndarray, prime: int) -> np.ndarray:
    out, step, left = np.ones(len(exponent), np.uint64), base, exponent.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)) == 1
        out[odd] = out[odd] * np.uint64(step) % np.uint64(prime)
        step, left = step * step % prime, left >> np.uint64(1)
    return out


def _terms(numbers: list[int]):
    """Each turn's digest, not zero, times base**(position - 1), modulo each prime."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = tb.column(batch, "d1").to_numpy().view(np.uint64)
            place = tb.column(batch, "pos").to_numpy() - 1
            terms = [(digest % np.uint64(p - 1) + np.uint64(1)) * _power(b, place, p) % np.uint64(p) for b, p in zip(numbers, PRIMES, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(t.astype(np.int64)) for t in terms]], [*batch.schema.names, *TERMS])
    return run


def _packed(residues: list[Column]) -> list[Column]:
    return [F.shiftleft(residues[0], 31).bitwiseOR(residues[1]), residues[2]]


def prefixes(turns: DataFrame, numbers: list[int]) -> DataFrame:
    """(conv_id, depth, fa, fb, pa, pb, d1..d4, bytes, ends): all prefixes of all rebuilt conversations, the empty ones first."""
    with_terms = turns.mapInArrow(_terms(numbers), "conv_id long, pos long, d1 long, d2 long, d3 long, d4 long, bytes long, t1 long, t2 long, t3 long")
    summed = ranked(with_terms, ["conv_id"], ["pos"], seq_col="again", sum_cols=dict(zip(SUMS, TERMS, strict=True))).drop("again")
    sums = written(summed.withColumns({u: F.col(u) % p for u, p in zip(SUMS, PRIMES, strict=True)}), "turn-sums")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    # of each conversation: its length and the sums of its own first h turns
    convs = (sums.withColumn("h", h).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("h").alias("h"),
        *[F.coalesce(F.max(F.when(F.col("pos") == F.col("h"), F.col(u))), F.lit(0)).cast("long").alias(f"own_{u}") for u in SUMS]))
    turn = F.struct("pos", *DIGEST, "bytes", *TERMS, *SUMS)
    heads = (sums.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= MOST_HEAD))
             .groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head")))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType))
    plan = (convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
            .withColumn("head", head).withColumn("m", F.size("head").cast("long"))
            .withColumns({f"head_{u}": F.when(F.col("m") > 0, F.element_at("head", -1)[u]).otherwise(F.lit(0)).cast("long") for u in SUMS})
            .withColumn("depth_of_end", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    plan = written(plan.drop("base"), "rebuilt")

    def row(depth: Column, now: list[Column], before: list[Column], source: str) -> list[Column]:
        fa, fb = _packed(now)
        pa_, pb = _packed(before)
        get = (lambda c: F.col(f"{source}.{c}")) if source else F.col
        return [F.col("conv_id"), depth.alias("depth"), fa.alias("fa"), fb.alias("fb"), pa_.alias("pa"), pb.alias("pb"),
                *[get(c).alias(c) for c in DIGEST], get("bytes").alias("bytes"), (depth == F.col("depth_of_end")).alias("ends")]

    def minus(a: Column, b: Column, p: int) -> Column:
        return F.pmod(a - b, F.lit(p))

    nothing = F.lit(0).cast("long")
    roots = plan.select("conv_id", nothing.alias("depth"), *[F.lit(x).cast("long").alias(c) for c, x in (("fa", 0), ("fb", 0), ("pa", -1), ("pb", -1))],
                        *[nothing.alias(c) for c in DIGEST], nothing.alias("bytes"), (F.col("depth_of_end") == 0).alias("ends"))
    from_head = plan.select("conv_id", "depth_of_end", F.explode("head").alias("x"))
    from_head = from_head.select(*row(F.col("x.pos"), [F.col(f"x.{u}") for u in SUMS],
                                      [minus(F.col(f"x.{u}"), F.col(f"x.{t}"), p) for u, t, p in zip(SUMS, TERMS, PRIMES, strict=True)], "x"))
    # own turns move from behind the own first h turns to behind the head: by at most h places to the front
    back = [F.array(*[F.lit(pow(pow(b, -1, p), i, p)).cast("long") for i in range(HEADS)]) for b, p in zip(numbers, PRIMES, strict=True)]
    own = sums.join(plan.drop("head", "n"), "conv_id").where(F.col("pos") > F.col("h"))

    def joined(upto: list[Column]) -> list[Column]:
        return [(F.col(f"head_{u}") + F.get(x, (F.col("h") - F.col("m")).cast("int")) * minus(s, F.col(f"own_{u}"), p)) % p
                for u, s, x, p in zip(SUMS, upto, back, PRIMES, strict=True)]

    own = own.select(*row(F.col("m") + F.col("pos") - F.col("h"), joined([F.col(u) for u in SUMS]),
                          joined([minus(F.col(u), F.col(t), p) for u, t, p in zip(SUMS, TERMS, PRIMES, strict=True)]), ""))
    return roots.unionByName(from_head).unionByName(own)


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (depth, fa, fb, pa, pb, rep, n_convs, bytes), and of them those whose rows are not alike."""
    alike = ["pa", "pb", *DIGEST]
    nodes = rows.groupBy("depth", "fa", "fb").agg(
        F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        *[F.min(c).alias(c) for c in alike], *[F.max(c).alias(f"max_{c}") for c in alike])
    nodes = written(nodes, "nodes")
    unlike = nodes.where(reduce(Column.__or__, [F.col(c) != F.col(f"max_{c}") for c in alike]))
    return nodes.select("depth", "fa", "fb", "pa", "pb", "rep", "n_convs", "bytes"), unlike


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and id: strings of a node's ids, of about PIECE bytes, with the first id of each."""
    key, ids, size = None, [], 0
    out: list[tuple] = []

    def leave():
        nonlocal ids, size
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        ids, size = [], 0

    def table():
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], ["depth", "fa", "fb", "first", "ids"])

    for batch in batches:
        for *node, conv in zip(*[tb.column(batch, c).to_pylist() for c in ("depth", "fa", "fb", "conv_id")], strict=True):
            if node != key or size > PIECE:
                leave()
                key = node
                if len(out) >= 1024:
                    yield table()
                    out = []
            ids.append(conv)
            size += len(str(conv)) + 1
    leave()
    yield table()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and first id: the SHA-256 of each node's strings, comma-joined."""
    key, code = None, None
    for batch in batches:
        out = []
        for *node, ids in zip(*[tb.column(batch, c).to_pylist() for c in ("depth", "fa", "fb", "ids")], strict=True):
            if node == key:
                code.update(b",")
            else:
                if key is not None:
                    out.append((*key, code.hexdigest()))
                key, code = node, hashlib.sha256()
            code.update(ids.encode())
        yield _hashes(out)
    yield _hashes([(*key, code.hexdigest())] if key is not None else [])


def _hashes(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["depth", "fa", "fb", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(depth, fa, fb, ends_sha256) of the nodes in which a conversation ends."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = ["depth", "fa", "fb"]
    last = rows.where("ends").select(*node, "conv_id")
    pieces = (last.repartitionByRange(n, *node, "conv_id").sortWithinPartitions(*node, "conv_id")
              .mapInArrow(_joined_ids, "depth long, fa long, fb long, first long, ids string"))
    return (pieces.repartition(n, *node).sortWithinPartitions(*node, "first")
            .mapInArrow(_hashed, "depth long, fa long, fb long, ends_sha256 string"))


def trie(conversations: DataFrame, attempts: int = 8) -> DataFrame:
    """The nodes of the prefix trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    turns = written(stored(conversations), "stored-turns")
    for attempt in range(attempts):
        rows = written(prefixes(turns, bases(attempt)), "prefixes")
        nodes, unlike = grouped(rows)
        if unlike.isEmpty():
            break
    else:
        raise RuntimeError("unlike prefixes share a fingerprint under every base")
    node = ["depth", "fa", "fb"]
    children = (nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    valued = nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = written(valued.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "nodes-valued")
    # the part of a path whose nodes a conversation names: where it begins, and its sums
    parts = written(valued.groupBy("rep").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("all_saved")), "own-parts")
    others = (rows.select("conv_id", *node).join(parts.withColumnRenamed("rep", "conv_id"), "conv_id").where(F.col("depth") < F.col("top"))
              .groupBy(*node).agg(F.sum("leaves").alias("other_leaves"), F.sum("all_saved").alias("other_saved")))
    below = ranked(valued, ["rep"], [F.desc("depth")], seq_col="up", sum_cols={"own_leaves": "leaf", "own_saved": "saved"})
    # only the first node of a part has its parent in another one
    upper = valued.select(F.col("depth").alias("up_depth"), F.col("fa").alias("up_a"), F.col("fb").alias("up_b"), F.col("rep").alias("up_rep"))
    tops = (valued.join(parts.select("rep", "top"), "rep").where((F.col("depth") == F.col("top")) & (F.col("depth") > 0)).select("rep", "depth", "pa", "pb")
            .join(upper, (F.col("depth") - 1 == F.col("up_depth")) & (F.col("pa") == F.col("up_a")) & (F.col("pb") == F.col("up_b")))
            .select("rep", "depth", "up_rep"))
    tops = written(tops, "tops")
    found = (below.join(others, node, "left").join(ends(rows), node, "left").join(tops, ["rep", "depth"], "left"))

    def plus(a: str, b: str) -> Column:
        return (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long")

    return found.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("up_rep", "rep")).alias("parent_conv_id"), "n_convs", "n_children",
        plus("own_leaves", "other_leaves").alias("n_leaves"), plus("own_saved", "other_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(load(spark, sf_dir, "conversations"))


#: Paths as lists of turn digests; crc32 by its table of 256 remainders.
ORACLE = r"""
WITH bits AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'m': md5(r || ':' || md5(x)), 'b': strlen(x)} ORDER BY pos) AS own FROM turns GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
        lambda a, s: xor(a >> 8, t[(xor(a, s) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 9 AS h FROM c, bits),
b AS (SELECT h.conv_id, list_concat(coalesce(base.own[1 : h.h], []), h.own[h.h + 1 :]) AS path
      FROM h LEFT JOIN c base ON base.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(path) AS n, list_transform(path[1 : d], lambda x: x.m) AS seq, CASE WHEN d = 0 THEN 0 ELSE path[d].b END AS bytes
      FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM b)),
nodes AS (SELECT d, seq, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM p GROUP BY d, seq),
kids AS (SELECT d - 1 AS d, seq[1 : d - 1] AS seq, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
v AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, seq)),
under AS (SELECT a.d, a.seq, sum((x.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.bytes)::BIGINT AS saved_tokens
          FROM v a JOIN v x ON x.d >= a.d AND x.seq[1 : a.d] = a.seq GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, under.n_leaves, under.saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN under USING (d, seq) LEFT JOIN v up ON up.d = v.d - 1 AND up.seq = v.seq[1 : v.d - 1]
"""
