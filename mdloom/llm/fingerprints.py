"""Homomorphic multiset fingerprints of documents (operator 7).

A text is the multiset of its paragraphs: its lines, those longer than
``LONG`` characters cut by content: before a place whose next ``WINDOW``
characters have a smaller hash than those of all ``RADIUS`` places on either
side in the line, so that a cut depends on its surroundings alone and an
inserted character moves no cut further off. What is still longer than ``MOST``
characters (one word over and over, say) is cut LONG to MOST characters after the last cut,
before the first place whose hash is as small as the smallest around, so that each
cut falls on the same letter of the word. Each paragraph is hashed to a wide
vector, and vectors are added lane by lane modulo powers of two:

* one count modulo 2**32,
* ``DENSE`` lanes modulo 2**16, all changed by every paragraph: equal multisets have
  equal lanes, others differ but for a chance of 2**-256,
* ``STABLE`` lanes modulo 2**32, to each of which a paragraph adds a Cauchy number
  drawn by its hash (in units of 1 / ``UNIT``).

Order does not matter, and paragraphs are inserted or deleted by addition or
subtraction. The difference of a stable lane is Cauchy again, as wide as the
symmetric difference of the multisets is large, repeats counted. Its width is the median
over the lanes (standard error 14 % at any size up to about 10 million
paragraphs), and with the counts it gives the likeness of two multisets: 1 for
equal ones, near 0 for strangers.

``fingerprint_edited`` compares a text with an edit of it (its last quarter
replaced from the next document in the order of doc_id) by deleting and
inserting only the paragraphs that the edit touches. Documents are dealt by
ranges of doc_id, and the first document of each range is also sent to the
range before it, so neighbours meet in one shuffle.

Results for odd input: null and empty texts have no paragraph (a fingerprint of
zeros); a null doc_id sorts first; ties on doc_id are ordered by the hash of the text;
repeated rows each get a row; a single document is its own next one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import load, text_key

LONG = 64
WINDOW = 4
#: A power of two; cuts are 2 * RADIUS + 1 characters apart on average.
RADIUS = 16
MOST = 128
#: Characters whose hashes are held at once.
SPAN = 1 << 16
DENSE = 16
STABLE = 128
UNIT = 64
#: Paragraphs whose numbers are held at once.
STEP = 512
_LANES = np.array([1 << 32] + [1 << 16] * DENSE + [1 << 32] * STABLE, np.int64)
_SEEDS = np.arange(1, STABLE // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _cauchy(u: np.ndarray, bits: int) -> np.ndarray:
    """Quantiles of the Cauchy distribution, in whole units."""
    return np.rint(np.tan(np.pi * ((u + 0.5) / (1 << bits) - 0.5)) * UNIT).astype(np.int64)


_QUANTILES = _cauchy(np.arange(1 << 16), 16)
#: Places of the table at either end, where the numbers are far apart and all 32 bits count.
_ENDS = 64


def _stable(keys: np.ndarray) -> np.ndarray:
    """The sum over the keys of STABLE Cauchy numbers each."""
    out = np.zeros(STABLE, np.int64)
    for i in range(0, len(keys), STEP):
        u = tb.mix(keys[i:i + STEP, None] ^ _SEEDS).view("<u4")
        top = (u >> np.uint32(16)).astype(np.uint16)
        x = _QUANTILES[top]
        ends = np.nonzero(top + np.uint16(_ENDS) < 2 * _ENDS)
        x[ends] = _cauchy(u[ends], 32)
        out += x.sum(axis=0)
    return out


def _cuts(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of long lines, joined by RADIUS line ends, whose window has the smallest hash around: alone, and with ties."""
    found, ties = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(joined), SPAN):
        a, b = max(0, at - RADIUS), at + SPAN + RADIUS + WINDOW - 1
        codes = np.frombuffer(joined[a:b].encode("utf-32-le", "surrogatepass"), "<u4")
        h = tb.runs(codes.astype(np.uint64), WINDOW)
        n = len(h)
        for i in range(WINDOW):
            h[codes[i:i + n] == 10] = top  # no window reaches beyond its line
        edge = np.full(RADIUS, top)
        low = np.concatenate((edge, h, edge))
        step = 1
        while step < RADIUS:  # the least of RADIUS values from each place on
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        around = np.minimum(low[:n], low[RADIUS + 1:])
        for out, least in ((found, h < around), (ties, (h <= around) & (h < top))):
            places = np.flatnonzero(least) + a
            out.append(places[(places >= at) & (places < at + SPAN)])
    return np.concatenate(found), np.concatenate(ties)


def paragraphs(text: str) -> list[str]:
    if not text:
        return []
    lines = text.split("\n")
    long = [line for line in lines if len(line) > LONG]
    if not long:
        return lines
    cuts, ties = _cuts(("\n" * RADIUS).join(long))
    begins = np.cumsum([0] + [len(line) + RADIUS for line in long])
    places, rows = cuts.tolist(), np.searchsorted(cuts, begins).tolist()
    out: list[str] = []
    k = 0
    for line in lines:
        if len(line) <= LONG:
            out.append(line)
            continue
        begin = int(begins[k])
        x = 0
        for y in [p - begin for p in places[rows[k]:rows[k + 1]]] + [len(line)]:
            while y - x > MOST:
                tie = int(np.searchsorted(ties, begin + x + LONG))
                z = min(x + MOST, int(ties[tie]) - begin if tie < len(ties) else y)
                out.append(line[x:z])
                x = z
            if y > x:
                out.append(line[x:y])
            x = y
        k += 1
    return out


def vector(parts: list[str]) -> np.ndarray:
    """The sum of the paragraphs' vectors, each lane modulo its power of two."""
    out = np.zeros(1 + DENSE + STABLE, np.int64)
    if parts:
        raw = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=2 * DENSE + 8).digest() for p in parts])
        rows = np.frombuffer(raw, "<u2").reshape(len(parts), DENSE + 4)
        out[0] = len(parts)
        out[1:1 + DENSE] = rows[:, :DENSE].sum(axis=0, dtype=np.int64)
        out[1 + DENSE:] = _stable(np.ascontiguousarray(rows[:, DENSE:]).view("<u8")[:, 0])
    return out % _LANES


def inserted(vec: np.ndarray, parts: list[str]) -> np.ndarray:
    return (vec + vector(parts)) % _LANES


def deleted(vec: np.ndarray, parts: list[str]) -> np.ndarray:
    return (vec - vector(parts)) % _LANES


def as_text(vec: np.ndarray) -> str:
    return (vec[:1].astype("<u4").tobytes() + vec[1:1 + DENSE].astype("<u2").tobytes() + vec[1 + DENSE:].astype("<u4").tobytes()).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal multisets; else their estimated Jaccard similarity."""
    if np.array_equal(a, b):
        return 1.0
    total = int(a[0] + b[0])
    least = max(1, abs(int(a[0] - b[0])))
    lanes = (a[1 + DENSE:] - b[1 + DENSE:] + (1 << 31)) % (1 << 32) - (1 << 31)
    apart = max(least, float(np.median(np.abs(lanes))) / UNIT)
    return max(0.0, (total - apart) / (total + apart))


def edited(text: str, other: str) -> str:
    """The last quarter of the characters replaced by as many of the start of ``other``."""
    k = len(text) // 4
    return text[:len(text) - k] + other[:k]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (shard, guest, doc_id, tkey): each document with the next; a shard's first guest ends it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last = None  # shard, doc_id, text, paragraphs, vector, and whether a guest has followed
    out: list[tuple] = []

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for part in tb.pieces(batches, "text"):
        for shard, guest, doc, text in zip(*(tb.column(part, c).to_pylist() for c in ("shard", "guest", "doc_id", "text")), strict=True):
            if guest and (last is None or last[0] != shard):
                continue  # another row with the doc_id of the guest
            text = text or ""
            parts = paragraphs(text)
            vec = vector(parts)
            if last is not None and last[0] == shard:
                _, own_id, own, own_parts, own_vec = last
                new = edited(own, text)
                new_parts = paragraphs(new)
                same = 0
                for a, b in zip(own_parts, new_parts, strict=False):
                    if a != b:
                        break
                    same += 1
                new_vec = inserted(deleted(own_vec, own_parts[same:]), new_parts[same:])
                out.append((own_id, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own_vec),
                            as_text(new_vec), likeness(own_vec, new_vec), likeness(own_vec, vec)))
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
            last = None if guest else (shard, doc, text, parts, vec)
    if out:
        yield batch_of(out)


def shard_of(col: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``col``, in two steps of about sqrt(n)."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    heads = bounds[step - 1::step]
    full = F.array(*[F.lit(b).cast("long") for b in bounds])
    whole = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in heads]), lambda x: x <= col)) * step
    return whole + F.size(F.filter(F.slice(full, whole + 1, step), lambda x: x <= col))


def fingerprint_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document."""
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    row = docs.select(order.alias("o")).agg(F.percentile_approx("o", cuts, 100 * parts).alias("cuts"), F.min("o").alias("first")).first()
    bounds = sorted(set(row["cuts"] or []) - {row["first"]})  # doc_ids that occur: each is the first of its shard
    last = len(bounds)
    own = shard_of(F.col("o"), bounds)
    keyed = docs.select("doc_id", order.alias("o"), text_key().alias("tkey"), "text").withColumn("own", own)
    before = F.when(F.col("o") == F.lit(row["first"]), F.lit(last)).when(
        F.col("o").isin(bounds) if bounds else F.lit(False), F.col("own") - 1)
    dealt = keyed.withColumn("to", F.explode(F.filter(F.array(
        F.struct(F.col("own").alias("shard"), F.lit(False).alias("guest")),
        F.struct(before.alias("shard"), F.lit(True).alias("guest"))), lambda x: x["shard"].isNotNull())))
    rows = dealt.select("to.shard", "to.guest", "doc_id", "o", "tkey", "text")
    return (rows.repartition(parts, "shard").sortWithinPartitions("shard", "guest", "o", "tkey").select("shard", "guest", "doc_id", "text")
            .mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                "near_edited double, near_next double"))


def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edited(load(spark, sf_dir, "documents"))
