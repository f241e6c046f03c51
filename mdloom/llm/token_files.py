"""Token ids in compressed files: canonical length-limited Huffman coding (operator 5).

Writing: every text is tokenised once and its ids (with the end id) written to
the shared folder; ids are counted over all documents; the driver turns the
counts (one per id of the vocabulary, so bounded) into code lengths by
package-merge. Documents are coded where they lie, then only the compressed
rows are shuffled, by ranges of doc_id, and joined into blocks.

File format: a folder with ``codebook`` (id, bits: canonical codes follow from
the lengths, by length then id), ``manifest`` (shard, ids before it and in it) and ``blocks/shard=N`` with
one row per block: the documents it holds (doc_ids, n_tokens), the run lengths
and bit offsets of its checkpoints, and the payload. A run is at most ``RUN``
ids of one document and starts at a full byte; its bit offset is a checkpoint, so a
block is decoded alone, and within it all runs at once, one table look-up per id. Shards and the rows
in them ascend by doc_id.

Results for odd input: null and empty texts hold the end id alone; null doc_ids
come first; repeated rows and ties on doc_id stand side by side, ordered by the
hash of the text; other columns are ignored; an empty table makes an empty folder that
reads back as no rows. A text of any length is coded whole, in one block of its own if need be.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import load, text_key, written
from mdloom.llm.tokenwords import encoder, forget, tokenizer_path
from mdloom.session import scratch_path

RUN = 1024
BLOCK_IDS = 1 << 20
SHARD_IDS = 1 << 24
MOST_BITS = 18
_BLOCK = "shard int, block long, doc_ids array<long>, n_tokens array<long>, run_ids array<int>, run_bits array<long>, payload binary"


# ---- codes ---------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << most:
        raise ValueError("more symbols than codes of that length")
    by = np.argsort(counts, kind="stable")
    leaves = counts[by].astype(np.float64)
    kinds: list[np.ndarray] = []  # per level, which of the sorted items are leaves
    packs = np.empty(0)
    for _ in range(most):
        items = np.concatenate((leaves, packs))
        order = np.argsort(items, kind="stable")
        kinds.append(order < n)
        items = items[order]
        packs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    bits = np.zeros(n, np.uint8)
    take = 2 * n - 2
    for leaf in reversed(kinds):
        m = int(leaf[:take].sum())
        bits[:m] += 1
        take = 2 * (take - m)
    out = np.empty(n, np.uint8)
    out[by] = bits
    return out


class Codebook:
    """Canonical codes from (id, bits), sorted by bits then id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        by = np.lexsort((ids, bits))
        self.ids, self.bits = ids[by].astype(np.uint32), bits[by].astype(np.int64)
        self.top = int(self.bits.max()) if len(ids) else 1
        # the first code of each length follows the last one of the length before
        step = np.left_shift(1, self.top - self.bits)
        self.codes = (np.concatenate(([0], np.cumsum(step)[:-1])) >> (self.top - self.bits)) if len(ids) else np.empty(0, np.int64)

    def for_writing(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        code, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.ids], bits[self.ids] = self.codes.astype(np.uint64), self.bits
        return code, bits

    def for_reading(self) -> tuple[np.ndarray, np.ndarray]:
        """By the next ``top`` bits: the id, and the bits of its code."""
        reps = np.left_shift(1, self.top - self.bits)
        ids, bits = np.zeros(1 << self.top, np.uint32), np.ones(1 << self.top, np.uint8)
        n = int(reps.sum())
        ids[:n], bits[:n] = np.repeat(self.ids, reps), np.repeat(self.bits, reps)
        return ids, bits


def encode_runs(ids: np.ndarray, run_ids: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload, and the byte offset of each run (run_ids: the number of ids in each)."""
    if not len(ids):
        return b"", np.zeros(len(run_ids), np.int64)
    length = bits[ids]
    upto = np.concatenate(([0], np.cumsum(length)))
    edge = np.concatenate(([0], np.cumsum(run_ids)))
    run_bytes = (upto[edge[1:]] - upto[edge[:-1]] + 7) >> 3
    at_byte = np.concatenate(([0], np.cumsum(run_bytes)))
    pos = upto[:-1] + np.repeat(at_byte[:-1] * 8 - upto[edge[:-1]], run_ids)
    word = pos >> 5
    shifted = code[ids] << (64 - (pos & 31) - length).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out = np.zeros((int(at_byte[-1]) >> 2) + 3, np.uint64)
    at = word[first]
    out[at] += np.add.reduceat(shifted >> np.uint64(32), first)
    out[at + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[:int(at_byte[-1])], at_byte[:-1]


def decode_runs(payload: bytes, run_ids: np.ndarray, run_bits: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """All runs side by side: step t reads the t-th id of each run that has one."""
    raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    top = len(ids).bit_length() - 1
    by = np.argsort(-run_ids, kind="stable")
    counts = run_ids[by]
    pos = run_bits[by].copy()
    start = (np.cumsum(run_ids) - run_ids)[by]
    out = np.empty(int(run_ids.sum()), np.uint32)
    left = np.searchsorted(-counts, -np.arange(int(counts[0]) if len(counts) else 0), side="left")  # runs longer than t
    mask = (1 << top) - 1
    for t, k in enumerate(left.tolist()):
        p = pos[:k]
        at = (window[p >> 3] >> (32 - top - (p & 7)).astype(np.uint32)) & mask
        out[start[:k] + t] = ids[at]
        pos[:k] = p + bits[at]
    return out


# ---- writing -------------------------------------------------------------------------------

def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in tb.pieces(batches, "text"):
            ids, counts = enc.encode(*tb.text_buffer(tb.column(part, "text")))
            if not part.num_rows:
                continue
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(counts) + 1)
            small = not len(ids) or int(ids.max()) < 1 << 16  # two bytes an id while they suffice
            width = 2 if small else 4
            raw = ids.astype("<u2" if small else "<u4").tobytes()
            cells = [raw[a * width:b * width] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [tb.column(part, "doc_id"), tb.column(part, "tkey"), pa.array(counts + 1, pa.int64()),
                 pa.array(np.full(len(cells), width, np.int32)), pa.array(cells, pa.binary())], ["doc_id", "tkey", "n", "width", "ids"])
        forget()
    return run


def _ids(cell: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cell, "<u2" if width == 2 else "<u4")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for cell, width in zip(tb.column(batch, "ids"), tb.column(batch, "width").to_pylist(), strict=True):
            c = np.bincount(_ids(cell.as_buffer(), width), minlength=len(total))
            c[:len(total)] += total
            total = c
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "count"])


def _coded(shipped, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bits = shipped.value
        for batch in batches:
            n = batch.num_rows
            at = 0
            widths, counts = tb.column(batch, "width").to_pylist(), tb.column(batch, "n").to_numpy()
            while at < n:
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(counts[at:]), BLOCK_IDS, side="right")))
                cells = tb.column(batch, "ids").slice(at, end - at)
                ids = np.concatenate([_ids(c.as_buffer(), w) for c, w in zip(cells, widths[at:end], strict=True)])
                runs, edge = [], [0]
                for c in counts[at:end].tolist():
                    own = [RUN] * (c // RUN) + ([c % RUN] if c % RUN else [])
                    runs += own
                    edge.append(len(runs))
                runs = np.asarray(runs, np.int64)
                payload, offs = encode_runs(ids, runs, code, bits)
                offs = np.append(offs, len(payload))
                doc = tb.column(batch, "doc_id").slice(at, end - at)
                order = doc.fill_null(np.iinfo(np.int64).min).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(bounds, order, side="right").astype(np.int32)), doc,
                     tb.column(batch, "tkey").slice(at, end - at), pa.array(counts[at:end]),
                     pa.array([(offs[a:b] - offs[a]).tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.list_(pa.int64())),
                     pa.array([payload[offs[a]:offs[b]] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())],
                    ["shard", "doc_id", "tkey", "n", "offs", "bits"])
                at = end
    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, doc_id, tkey): whole documents gathered into blocks."""
    names = ["shard", "block", "doc_ids", "n_tokens", "run_ids", "run_bits", "payload"]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
    shard, block, held, size = None, 0, [], 0

    def out():
        run_ids, run_bits, at = [], [], 0
        for _, n, offs, bits in held:
            run_ids += [RUN] * (n // RUN) + ([n % RUN] if n % RUN else [])
            run_bits += [(at + o) * 8 for o in offs]
            at += len(bits)
        row = (shard, block, [h[0] for h in held], [h[1] for h in held], run_ids, run_bits, b"".join([h[3] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        for s, doc, n, offs, bits in zip(*(tb.column(batch, c).to_pylist() for c in ("shard", "doc_id", "n", "offs", "bits")), strict=True):
            if held and (s != shard or size + n > BLOCK_IDS):
                yield out()
                block, held, size = (block + 1 if s == shard else 0), [], 0
            shard = s
            held.append((doc, n, offs, bits))
            size += n
    if held:
        yield out()


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end_id: int = 1) -> None:
    """Write the ids of all texts to the folder ``out`` (see the head of this module)."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", text_key().alias("tkey"), "text")
    table = written(keyed.mapInArrow(_tokenised(path or tokenizer_path("word_bpe_49k.json"), end_id),
                                     "doc_id long, tkey long, n long, width int, ids binary"), "token-ids")
    # at most one row per id of the vocabulary
    counts = (table.select("width", "ids").mapInArrow(_counted, "id long, count long")
              .groupBy("id").agg(F.sum("count").alias("count")).orderBy("id").toPandas())
    bits = code_lengths(counts["count"].to_numpy(np.int64), max(MOST_BITS, max(1, len(counts)).bit_length() + 2))
    book = Codebook(counts["id"].to_numpy(np.int64), bits)
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(book.ids, book.bits, strict=True)], "id long, bits int") \
        .coalesce(1).write.parquet(os.path.join(out, "codebook"))
    total = table.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_IDS))
    bounds: list = []
    if shards > 1:  # doc_ids that part the documents evenly; the driver holds one per shard
        cuts = [i / shards for i in range(1, shards)]
        bounds = sorted(set(table.agg(F.percentile_approx("doc_id", cuts, 10 * shards)).first()[0] or []))
    shipped = spark.sparkContext.broadcast(book.for_writing())
    coded = table.mapInArrow(_coded(shipped, np.asarray(bounds, np.int64)),
                             "shard int, doc_id long, tkey long, n long, offs array<long>, bits binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (coded.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "tkey").mapInArrow(_joined, _BLOCK)
     .write.partitionBy("shard").parquet(os.path.join(out, "blocks")))
    sizes = read_blocks(spark, out).groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    sizes.select("shard", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before")).write.parquet(os.path.join(out, "manifest"))


# ---- reading -------------------------------------------------------------------------------

def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCK).parquet(os.path.join(folder, "blocks"))


def codebook(spark: SparkSession, folder: str) -> Codebook:
    rows = spark.read.parquet(os.path.join(folder, "codebook")).toPandas()  # one row per id of the vocabulary
    return Codebook(rows["id"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64))


def decoded_blocks(tables, batches: Iterator[pa.RecordBatch]):
    """(doc_ids, n_tokens, ids of the block, row) of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_runs(row["payload"], np.asarray(row["run_ids"], np.int64), np.asarray(row["run_bits"], np.int64), *tables)
            yield row["doc_ids"], row["n_tokens"], ids, row


def _documents(shipped, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, counts, ids, row in decoded_blocks(shipped.value, batches):
            raw = ids.astype("<u4").tobytes()
            ends = np.cumsum(counts)
            starts = ends - counts
            cells = [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            cols = [pa.array(docs, pa.int64()), pa.array([row["shard"]] * len(docs), pa.int32()), pa.array([row["block"]] * len(docs), pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(c) for c in cells], pa.int64())]
            names = ["doc_id", "shard", "block", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(c, "<u4").tolist() for c in cells], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids if asked for."""
    shipped = spark.sparkContext.broadcast(codebook(spark, folder).for_reading())
    blocks = read_blocks(spark, folder)
    docs = blocks.mapInArrow(_documents(shipped, with_ids),
                             "doc_id long, shard int, block long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # SHARD_IDS / BLOCK_IDS rows
    offsets = (blocks.select("shard", "block", size.alias("ids")).withColumn("in_shard", F.coalesce(F.sum("ids").over(before), F.lit(0)))
               .join(spark.read.parquet(os.path.join(folder, "manifest")).select("shard", "ids_before"), "shard")
               .select("shard", "block", (F.col("in_shard") + F.col("ids_before")).alias("block_start")))
    return (docs.join(offsets, ["shard", "block"])
            .select("doc_id", (F.col("block_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids))


def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder)
    return read_token_files(spark, folder)
