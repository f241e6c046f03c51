"""Passages that repeat across documents, by a sparse suffix array (operator 1).

A suffix is kept where its first ``GRAM`` words are the least hash of some
window of ``WINDOW`` such grams (a minimiser), which the content alone decides:
every passage of ``min_words`` holds one within its first ``WINDOW`` words, at
the same place in each of its copies. Kept suffixes are sorted by their first
``min_words - WINDOW + 1`` words (by hash) and compared with their neighbours; those equal to
a suffix of another document are extended to the left by up to ``WINDOW - 1``
words and to the right, to all ``min_words``-word passages around them, which
are sorted and compared again. A passage counts if another document holds it,
so the repeated passages are found exactly (up to 64-bit hashes) and
overlapping ones are merged into maximal spans. No pairs of documents are made:
work is linear in the rows, however large a group of copies is.

Equal texts are one class; if several documents hold it and it has at least
``min_words`` words, all of it is a repeated span. A key that one slice of the
input already finds in two documents is settled there and sends a single
witness on, so a hot passage costs one row per slice, not one per document.

Results for odd input: null, empty and short texts have no spans; repeated rows
are copies of each other (a row each); null doc_ids stay in the result; other
columns are ignored; an empty table gives an empty result. Repeats inside one
document alone do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import load, text_key, written

GRAM = 8
WINDOW = 24
_ROW = ["proven", "deal", "key", "tkey", "pos"]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i:i+width] for each i, in log(width) steps."""
    have, span = x, 1
    while span * 2 <= width:
        have = pick(have[:len(have) - span], have[span:])
        span *= 2
    if span < width:
        have = pick(have[:len(have) - (width - span)], have[width - span:])
    return have


def sampled(w: tb.Words, room: int) -> np.ndarray:
    """Word positions of minimisers that have ``room`` words of their text from there on."""
    n = len(w)
    grams = tb.runs(w.hashes, GRAM)
    if len(grams) < WINDOW:
        return np.empty(0, np.int64)
    least = _slide(grams, WINDOW, np.minimum)
    ends = np.repeat(w.offs[1:], w.counts)  # each word's text ends here
    at = np.arange(len(least))
    least[at + WINDOW + GRAM - 1 > ends[:len(least)]] = 0  # the window leaves its text
    edge = np.zeros(WINDOW - 1, np.uint64)
    most = _slide(np.concatenate((edge, least, edge)), WINDOW, np.maximum)
    at = np.flatnonzero(most[:len(grams)] == grams)
    return at[at + room <= ends[at]] if n else at


def passages(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on, in time independent of width."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * tb._powers(tb._BASE, n), out=total[1:])
    return tb.mix((total[width:] - total[:n - width + 1]) * tb._powers(tb._INVERSE, n)[:n - width + 1])


def _settled(keys: np.ndarray, texts: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one slice: those proven here, a witness for each such key, the rest."""
    if not len(keys):
        return
    by = np.argsort(keys, kind="stable")
    keys, texts, pos = keys[by], texts[by], pos[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    several = np.minimum.reduceat(texts, first) != np.maximum.reduceat(texts, first)
    proven = np.repeat(several, np.diff(np.append(first, len(keys))))
    key = tb.signed(keys)
    lead = first[several]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((proven, np.zeros(len(lead), bool)))),
         pa.array(np.concatenate((np.where(proven, texts, key), key[lead]))),
         pa.array(np.concatenate((key, key[lead]))), pa.array(np.concatenate((texts, texts[lead]))),
         pa.array(np.concatenate((pos, np.full(len(lead), -1))).astype(np.int32))], _ROW)


def _suffixes(room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in tb.pieces(batches, "text", 1 << 23):
            tkeys = tb.column(part, "tkey").to_numpy()
            fresh = [i for i, t in enumerate(tkeys.tolist()) if t not in seen and not seen.add(t)]
            w = tb.words(*tb.text_buffer(tb.column(part, "text").take(pa.array(fresh, pa.int64()))))
            at = sampled(w, room)
            row = np.searchsorted(w.offs, at, side="right") - 1
            yield from _settled(passages(w.hashes, room)[at] if len(at) else at.astype(np.uint64),
                                tkeys[fresh][row], at - w.offs[row])
    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: proven ones pass; others pass if their key occurs in two texts.
    Held back: the rows of the last key, at most one per slice and those of one text."""
    def out(tkey, pos):
        good = pos >= 0
        return pa.RecordBatch.from_arrays([pa.array(tkey[good]), pa.array(pos[good])], ["tkey", "pos"])

    held = None
    for batch in batches:
        proven, key, tkey, pos = (tb.column(batch, c).to_numpy(zero_copy_only=False) for c in ("proven", "key", "tkey", "pos"))
        if proven.any():
            yield out(tkey[proven], pos[proven])
        key, tkey, pos = key[~proven], tkey[~proven], pos[~proven]
        if held is not None:
            key, tkey, pos = (np.concatenate(x) for x in zip(held, (key, tkey, pos), strict=True))
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        cut = first[-1]
        held = (key[cut:], tkey[cut:], pos[cut:])
        if len(first) > 1:
            several = np.minimum.reduceat(tkey[:cut], first[:-1]) != np.maximum.reduceat(tkey[:cut], first[:-1])
            good = np.repeat(several, np.diff(first))
            yield out(tkey[:cut][good], pos[:cut][good])
    if held is not None and len(held[1]) and held[1].min() != held[1].max():
        yield out(held[1], held[2])


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """(tkey, pos) of the rows whose key another text has too."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartition(parts, "deal").sortWithinPartitions("key", "tkey").mapInArrow(_neighbours, "tkey long, pos int"), name)


def _extended(min_words: int):
    """All passages of min_words that hold one of the anchors in their first WINDOW words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.pieces(batches, "text", 1 << 23):
            tkeys = tb.column(part, "tkey").to_numpy()
            w = tb.words(*tb.text_buffer(tb.column(part, "text")))
            mark = np.zeros(len(w) + 1, np.int32)
            anchors = tb.column(part, "anchors")
            sizes = np.asarray([len(x) if x.is_valid else 0 for x in anchors], np.int64)
            row = np.repeat(np.arange(part.num_rows), sizes)
            at = anchors.flatten().to_numpy().astype(np.int64) + w.offs[row]
            lo = np.maximum(at - (WINDOW - 1), w.offs[row])
            hi = np.minimum(at, w.offs[row + 1] - min_words)
            good = hi >= lo
            np.add.at(mark, lo[good], 1)
            np.add.at(mark, hi[good] + 1, -1)
            start = np.flatnonzero(np.cumsum(mark) > 0)
            row = np.searchsorted(w.offs, start, side="right") - 1
            if len(start):
                yield from _settled(passages(w.hashes, min_words)[start], tkeys[row], start - w.offs[row])
    return run


def _spans(min_words: int):
    """Rows sorted by (tkey, pos): overlapping or touching passages become one span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # tkey, start, last pos
        for batch in batches:
            tkey, pos = tb.column(batch, "tkey").to_numpy(), tb.column(batch, "pos").to_numpy().astype(np.int64)
            if not len(tkey):
                continue
            new = np.ones(len(tkey), bool)
            new[1:] = (tkey[1:] != tkey[:-1]) | (pos[1:] > pos[:-1] + min_words)
            if open_ is not None:
                new[0] = tkey[0] != open_[0] or pos[0] > open_[2] + min_words
            first = np.flatnonzero(new)
            until = int(first[0]) if len(first) else len(tkey)
            done = []
            if open_ is not None:
                if until:  # rows that go on with the open span
                    open_ = (open_[0], open_[1], int(pos[until - 1]))
                if len(first):
                    done.append(open_)
            if len(first):
                ends = np.append(first[1:], len(tkey)) - 1
                done += zip(tkey[first].tolist(), pos[first].tolist(), pos[ends].tolist(), strict=True)
                open_ = done.pop()
            if done:
                a, b, c = (list(x) for x in zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                                  pa.array([x + min_words for x in c], pa.int64())], ["tkey", "start", "stop"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_[0]], pa.int64()), pa.array([open_[1]], pa.int64()),
                                              pa.array([open_[2] + min_words], pa.int64())], ["tkey", "start", "stop"])
    return run


def repeated_spans(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row per document and maximal span of words covered by passages of at
    least ``min_words`` words that another document holds too: doc_id, start and
    stop (word numbers, stop exclusive), n_words, copies (documents of the very same text)."""
    if min_words < WINDOW + GRAM - 1:
        raise ValueError(f"min_words must be at least {WINDOW + GRAM - 1}")
    room = min_words - WINDOW + 1
    own = docs.select("doc_id", "text")
    keyed = own.withColumn("tkey", text_key())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = written(own.select("doc_id", text_key().alias("tkey"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
                  .where(F.col("words") >= min_words), "passage-ids")
    classes = ids.groupBy("tkey").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.min("words").alias("words"))
    anchors = _shared(keyed.select("tkey", "text").where(F.col("text").isNotNull())
                      .mapInArrow(_suffixes(room), "proven boolean, deal long, key long, tkey long, pos int"), "passage-anchors")
    wanted = (anchors.groupBy("tkey").agg(F.collect_set("pos").alias("anchors"))
              .join(classes.select(F.col("tkey").alias("rep_key"), "rep_id"), F.col("tkey") == F.col("rep_key")).drop("tkey"))
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["rep_id"]) & (keyed["tkey"] == wanted["rep_key"])).select("tkey", "text", "anchors")
    repeated = _shared(texts.mapInArrow(_extended(min_words), "proven boolean, deal long, key long, tkey long, pos int"), "passage-windows")
    found = repeated.repartition(parts, "tkey").sortWithinPartitions("tkey", "pos").mapInArrow(_spans(min_words), "tkey long, start long, stop long")
    whole = classes.where("copies > 1").select("tkey", F.lit(0).cast("long").alias("start"), F.col("words").alias("stop"))
    spans = found.join(whole.select("tkey"), "tkey", "left_anti").unionByName(whole)
    return (ids.select("doc_id", "tkey").join(spans.join(classes.select("tkey", "copies"), "tkey"), "tkey")
            .select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "copies"))


def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(load(spark, sf_dir, "documents"))


#: Every 50-word passage, its number of distinct texts, and the spans they cover.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
ids AS (SELECT doc_id, text, w, len(w) AS words, count(*) OVER (PARTITION BY text) AS copies FROM d WHERE len(w) >= 50),
texts AS (SELECT text, any_value(w) AS w, any_value(copies) AS copies FROM ids GROUP BY text),
wins AS (SELECT text, copies, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS k
         FROM (SELECT text, copies, w, unnest(range(0, len(w) - 49)) AS p FROM texts)),
hit AS (SELECT text, p FROM (SELECT *, count(DISTINCT md5(text)) OVER (PARTITION BY k) AS n FROM wins) WHERE n > 1 AND copies = 1),
marked AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY text ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY text ORDER BY p) AS g FROM marked),
spans AS (SELECT text, min(p) AS start, max(p) + 50 AS stop FROM grouped GROUP BY text, g
          UNION ALL SELECT text, 0, len(w) FROM texts WHERE copies > 1)
SELECT i.doc_id, CAST(s.start AS BIGINT) AS start, CAST(s.stop AS BIGINT) AS stop, CAST(s.stop - s.start AS BIGINT) AS n_words, i.copies
FROM ids i JOIN spans s USING (text)
"""
