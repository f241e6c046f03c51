"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 11).

The benchmark's windows of ``window`` words are the patterns, the words of a text
its symbols. Per pattern length there are two tables:

* block shifts: for each run of up to three words (its hash modulo the table's
  size) how far a window may move on before such a block could end it. Positions in
  between cannot hold a pattern and are never looked at;
* suffix buckets: where a block may end a pattern (shift 0), the patterns whose last
  block falls into that slot, sorted by the hash of the whole pattern.

A position whose window is found in its bucket is compared with the pattern's
bytes, so hashes decide nothing alone. Texts are searched in lanes: all
segments of ``SEGMENT`` start positions of an Arrow batch move on together, each by its own shifts.

Items of fewer words than a window are one pattern of their own length, with
tables of that length. The patterns are shipped to the tasks in blocks of at
most ``BLOCK_BYTES`` of item text (longer items in pieces that overlap by a
window less one word); each block is one more narrow pass over the
documents. Nothing is shuffled but the benchmark.

Results for odd input: a null text has no words, so it neither hits nor is
hit; repeated rows and null doc_ids keep a row each; rows of the benchmark with one
item_id are one item, those without one together are one item too (null, listed
first and as an empty text); items without words give no pattern; other columns of the
documents are kept as they are, those of the benchmark are ignored; empty tables give
rows without hits or none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import load, written
from mdloom.operators.order import ranked

U64 = np.uint64
WINDOW = 10
SEGMENT = 256
BLOCK_BYTES = 1 << 23
#: Words of an item in one row of the pattern table.
PIECE = 1 << 14
#: At least so many slots per pattern in the shift table, and at most 2**MOST_BITS of them.
SLOTS_PER_PATTERN, MOST_BITS = 16, 24
#: Matches whose bytes are compared at once.
COMPARED = 1 << 15

#: A word is a run of digits, letters and all bytes from 0x80 on.
IS_GAP = np.ones(256, dtype=bool)
IS_GAP[48:58] = IS_GAP[65:91] = IS_GAP[97:123] = IS_GAP[128:] = False


class Compact:
    """The words of a batch: hashes, their bytes without what is between them, word offsets in those."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.words = tb.words(data, offs, IS_GAP)
        w = self.words
        self.hashes = w.hashes
        self.bytes = tb.LOWER[data[~IS_GAP[data]]]
        self.lens = w.ends - w.starts
        self.at = np.concatenate(([0], np.cumsum(self.lens)))


def _block_width(length: int) -> int:
    return 3 if length >= 6 else 2 if length >= 3 else 1


def _slots(hashes: np.ndarray, last: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Slot of the block of ``width`` words that ends at each position ``last``."""
    acc = np.zeros(len(last), U64)
    for j in range(width - 1, -1, -1):
        acc = acc * U64(0xA0761D6478BD642F) + hashes[last - j]
    return (tb.mix(acc) >> U64(64 - bits)).astype(np.int64)


class Patterns:
    """Shift table and suffix buckets of all patterns of one length."""

    def __init__(self, length: int, text: Compact, starts: np.ndarray, items: np.ndarray):
        """Patterns are ``length`` words of ``text`` from each of ``starts`` on, of the item numbers ``items``."""
        self.length, self.text, self.width = length, text, _block_width(length)
        whole = tb.runs(text.hashes, length)[starts]
        self.bits = max(4, min(MOST_BITS, (len(starts) * SLOTS_PER_PATTERN).bit_length()))
        self.farthest = length - self.width + 1
        self.shift = np.full(1 << self.bits, self.farthest, np.uint8 if length < 256 else np.int32)
        for back in range(self.farthest - 1, -1, -1):  # nearer blocks are written later and win
            self.shift[_slots(text.hashes, starts + length - 1 - back, self.width, self.bits)] = back
        suffix = _slots(text.hashes, starts + length - 1, self.width, self.bits)
        by = np.lexsort((starts, whole, suffix))
        self.starts, self.items, self.whole, suffix = starts[by], items[by], whole[by], suffix[by]
        # patterns of equal hash are neighbours; each such run is searched once and compared one by one
        new = np.flatnonzero(np.concatenate(([True], (suffix[1:] != suffix[:-1]) | (self.whole[1:] != self.whole[:-1]))))
        self.first, self.last = new, np.append(new[1:], len(by))
        self.bucket = suffix[new]
        self.key = self.whole[new]

    def candidates(self, hashes: np.ndarray, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, run) where the bucket of the position's last block holds its window's hash."""
        lo, hi = np.searchsorted(self.bucket, slot), np.searchsorted(self.bucket, slot, side="right")
        some = hi > lo
        at, lo, hi = at[some], lo[some], hi[some]
        if not len(at):
            return at, lo
        acc = np.zeros(len(at), U64)
        for j in range(self.length):
            acc = acc * U64(0xA0761D6478BD642F) + hashes[at + j]
        window, end = tb.mix(acc), hi
        while (hi > lo).any():  # binary search inside each bucket
            mid = (lo + hi) >> 1
            less = self.key[np.minimum(mid, len(self.key) - 1)] < window
            open_ = hi > lo
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        hit = (lo < end) & (self.key[np.minimum(lo, len(self.key) - 1)] == window)
        return at[hit], lo[hit]

    def search(self, text: Compact, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and runs of candidates among the start positions begin[i]:stop[i] of each lane."""
        places, runs = [], []
        at, stop = begin.copy(), stop
        while len(at):
            slot = _slots(text.hashes, at + self.length - 1, self.width, self.bits)
            step = self.shift[slot].astype(np.int64)
            here = np.flatnonzero(step == 0)
            if len(here):
                p, r = self.candidates(text.hashes, at[here], slot[here])
                places.append(p)
                runs.append(r)
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        none = np.empty(0, np.int64)
        return (np.concatenate(places), np.concatenate(runs)) if places else (none, none)

    def confirmed(self, text: Compact, places: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) for all patterns whose words are those at the place, byte by byte."""
        n = self.last[runs] - self.first[runs]
        upto = np.concatenate(([0], np.cumsum(n)))
        good_at, good_pattern = [], []
        for a in range(0, int(upto[-1]), COMPARED):
            ks = np.arange(a, min(a + COMPARED, int(upto[-1])))
            which = np.searchsorted(upto, ks, side="right") - 1
            place, pattern = places[which], self.first[runs[which]] + ks - upto[which]
            start = self.starts[pattern]
            same = np.ones(len(ks), bool)
            for j in range(self.length):
                same &= text.lens[place + j] == self.text.lens[start + j]
            place, pattern, start = place[same], pattern[same], start[same]
            size = text.at[place + self.length] - text.at[place]
            differ = np.zeros(len(place), bool)
            cut = 0
            while cut < len(place):  # bounded numbers of bytes at a time
                till = max(cut + 1, int(np.searchsorted(np.cumsum(size[cut:]), 1 << 22, side="right")) + cut)
                row = np.repeat(np.arange(cut, till), size[cut:till])
                inside = np.arange(len(row)) - np.repeat(np.cumsum(size[cut:till]) - size[cut:till], size[cut:till])
                unlike = text.bytes[text.at[place[row]] + inside] != self.text.bytes[self.text.at[start[row]] + inside]
                differ[row[unlike]] = True
                cut = till
            good_at.append(place[~differ])
            good_pattern.append(pattern[~differ])
        none = np.empty(0, np.int64)
        return (np.concatenate(good_at), np.concatenate(good_pattern)) if good_at else (none, none)


def patterns(rows: pa.Table, window: int = WINDOW) -> list[Patterns]:
    """One table per pattern length, from rows (number, text)."""
    data, offs = tb.text_buffer(rows.column("text").combine_chunks())
    text = Compact(data, offs)
    number = rows.column("number").to_numpy()
    counts = text.words.counts
    # a row of at least a window holds one from each of its words on but the last few; a shorter one is one pattern
    per_row = np.where(counts >= window, counts - window + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), per_row)
    start = text.words.offs[row] + np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    length = np.minimum(counts[row], window)
    return [Patterns(int(n), text, start[length == n], number[row[length == n]]) for n in np.unique(length).tolist()]


def _searched(shipped, back: list[str]):
    """Rows with the word intervals that this block hits, and the numbers of its items, added to those so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = patterns(pa.ipc.open_stream(shipped.value).read_all())
        for part in tb.pieces(batches, "text"):
            if not part.num_rows:
                continue
            data, offs = tb.text_buffer(tb.column(part, "text"))
            text = Compact(data, offs)
            n_rows, w = part.num_rows, text.words
            marks = np.zeros(len(w) + 1, np.int32)
            spans_before, items_before = tb.column(part, "_w").to_pylist(), tb.column(part, "_items").to_pylist()
            for row, old in enumerate(spans_before):
                for s in old:
                    marks[w.offs[row] + s["start"]] += 1
                    marks[w.offs[row] + s["stop"]] -= 1
            found: dict[int, set] = {}
            for table in tables:
                last = np.maximum(w.offs[1:] - table.length + 1, w.offs[:-1])
                per_row = -(-(last - w.offs[:-1]) // SEGMENT)
                lane_row = np.repeat(np.arange(n_rows), per_row)
                begin = w.offs[lane_row] + SEGMENT * (np.arange(len(lane_row)) - np.repeat(np.cumsum(per_row) - per_row, per_row))
                place, pattern = table.confirmed(text, *table.search(text, begin, np.minimum(begin + SEGMENT, last[lane_row])))
                np.add.at(marks, place, 1)
                np.add.at(marks, place + table.length, -1)
                row = np.searchsorted(w.offs, place, side="right") - 1
                pairs = np.unique(np.stack([row, table.items[pattern]]), axis=1)
                for r, i in zip(*pairs.tolist(), strict=True):
                    found.setdefault(r, set()).add(i)
            hit = np.cumsum(marks[:-1]) > 0
            spans, items = [[] for _ in range(n_rows)], [found.get(i, set()) | set(items_before[i]) for i in range(n_rows)]
            edge = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])) | _firsts(hit, w.offs))
            ends = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])) | _lasts(hit, w.offs)) + 1
            char = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if len(edge) else None
            for a, b in zip(edge.tolist(), ends.tolist(), strict=True):
                r = int(np.searchsorted(w.offs, a, side="right")) - 1
                base, row_at = w.offs[r], char[offs[r]]
                spans[r].append({"start": a - base, "stop": b - base, "from": char[w.starts[a]] - row_at, "to": char[w.ends[b - 1]] - row_at})
            cols = {"_row": tb.column(part, "_row"), "text": tb.column(part, "text"), "_n": pa.array(w.counts, pa.int64()),
                    "_w": pa.array(spans, pa.list_(_SPAN)), "_items": pa.array([sorted(x) for x in items], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([cols[c] for c in back], back)
    return run


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])


def _firsts(hit: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hit), bool)
    out[offs[:-1][offs[:-1] < len(hit)]] = True
    return out & hit


def _lasts(hit: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hit), bool)
    out[offs[1:][offs[1:] > 0] - 1] = True
    return out & hit


def _cut(window: int):
    """Items in rows of at most PIECE words that overlap by a window less one word; words are parted by one blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.pieces(batches, "text"):
            data, offs = tb.text_buffer(tb.column(part, "text"))
            w = tb.words(data, offs, IS_GAP)
            ids, cuts = [], []
            for item, a, b in zip(tb.column(part, "item_id").to_pylist(), w.offs[:-1].tolist(), w.offs[1:].tolist(), strict=True):
                for s in range(a, max(b - window + 1, a + 1) if b > a else a, PIECE):
                    e = min(b, s + PIECE + window - 1)
                    ids.append(item)
                    cuts.append(b" ".join(data[x:y].tobytes() for x, y in zip(w.starts[s:e].tolist(), w.ends[s:e].tolist(), strict=True)).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cuts, pa.string())], ["item_id", "text"])
    return run


def pattern_blocks(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(block, number, item_id, text): the benchmark in pieces, dealt into blocks of about BLOCK_BYTES; ``number`` tells items."""
    cut = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_cut(window), "item_id long, text string").distinct()
    sized = written(cut.withColumns({"size": F.octet_length("text").cast("long"), "one": F.lit(1), "nameless": F.col("item_id").isNull()}), "patterns")
    named = sized.select("item_id").distinct()
    # a place in the order of ids tells an item; the null one comes first
    numbers = ranked(named.withColumn("one", F.lit(1)), ["one"], [F.col("item_id").asc_nulls_first()], seq_col="number").select(F.col("item_id").alias("of"), "number")
    placed = ranked(sized, ["one"], [F.col("item_id").asc_nulls_first(), "text"], seq_col="place", sum_cols={"upto": "size"})
    return (placed.join(numbers, F.col("item_id").eqNullSafe(F.col("of")))
            .select(F.floor((F.col("upto") - F.col("size")) / BLOCK_BYTES).alias("block"), "number", "item_id", "text"))


def contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all) with one more, ``found``: n_words, n_hit (words inside an occurrence), ``spans`` (array of
    (start, stop) in code points: the hit passages, merged) and ``item_ids`` (items with a window that occurs, sorted as text)."""
    keep = docs.columns if keep is None else keep
    others = [c for c in keep if c != "text"]
    blocks = written(pattern_blocks(bench, window), "pattern-blocks")
    numbers = [r["block"] for r in blocks.select("block").distinct().orderBy("block").collect()]  # item bytes / BLOCK_BYTES
    row = F.struct(F.lit(0).alias("c"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)])
    wide = docs.select(row.alias("_row"), docs["text"].alias("text"), F.lit(0).cast("long").alias("_n"),
                       F.from_json(F.lit("[]"), _SPANS).alias("_w"), F.from_json(F.lit("[]"), "array<long>").alias("_items"))
    for i, number in enumerate(numbers or [None]):
        rows = blocks.where(F.col("block") == F.lit(number)).select("number", "text").toArrow().cast(_PATTERNS)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        back = [c for c in wide.columns if c != "text" or "text" in keep or i + 1 < len(numbers)]
        shipped = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
        wide = wide.mapInArrow(_searched(shipped, back), wide.select(back).schema)
    named = blocks.select("number", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id")).distinct()
    return _with_names(wide, named, others, keep)


_SPANS = "array<struct<start:long,stop:long,from:long,to:long>>"
_PATTERNS = pa.schema([("number", pa.int64()), ("text", pa.large_string())])


def _with_names(wide: DataFrame, named: DataFrame, others: list[str], keep: list[str]) -> DataFrame:
    """Numbers of items turned into their ids, by a join for the rows with a hit alone."""
    stats = F.struct(F.col("_n").alias("n_words"),
                     F.aggregate("_w", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_hit"),
                     F.transform("_w", lambda s: F.struct(s["from"].alias("start"), s["to"].alias("stop"))).alias("spans")).alias("_s")
    kept = written(wide.select("_row", *[c for c in wide.columns if c == "text"], stats, "_items"), "searched")
    hit = kept.where(F.size("_items") > 0)
    ids = (hit.select(F.col("_items").alias("_of")).distinct().select("_of", F.explode("_of").alias("number")).join(named, "number")
           .groupBy("_of").agg(F.array_sort(F.collect_list("id")).alias("_ids")))
    free = kept.where(F.size("_items") == 0).withColumn("_ids", F.array().cast("array<string>"))
    every = free.unionByName(hit.join(ids, F.col("_items") == F.col("_of")).drop("_of"))
    found = F.struct("_s.n_words", "_s.n_hit", "_s.spans", F.col("_ids").alias("item_ids")).alias("found")
    return every.select(*[F.col("text") if c == "text" else F.col(f"_row.c{others.index(c)}").alias(c) for c in keep], found)


def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.col("found.item_ids")
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size(ids).cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


#: Windows as texts of their words, joined; hit words are counted by place.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM p),
o AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s
      FROM (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT o.doc_id, o.k, o.i, p.item_id FROM o JOIN p ON o.s = p.s AND o.k = p.k),
places AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
