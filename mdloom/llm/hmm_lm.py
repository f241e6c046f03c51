"""Hidden Markov language model (operator 4).

Words are counted over all training documents. The model's alphabet has a
symbol for each of the ``OWN`` most frequent words, ``BUCKETS`` symbols that
share the other words by hash, and one for the end of a text. ``STATES`` latent
states are trained by Baum-Welch over the whole training set: each task runs
the scaled forward and backward recursions over its texts, and its expected
counts are summed by Spark. (For training, texts are cut every ``SEGMENT``
symbols, so that texts of any length run side by side.)

Scoring is exact: the scaled forward recursion over the whole text gives the
probability of its symbols; a word in a bucket has the share (c + 0.1) of its
bucket's counts, where each bucket keeps 0.1 for unseen words. So the score is
the log10 probability of the text's words and its end.

Counts reach the documents in two ways: those of the ``FREQUENT`` most frequent
words (a fixed bound) are shipped to the tasks; all others are joined by word,
and as those are rare, no word of that join is hot.

Results for odd input: null and empty texts are one end token; a null doc_id is
neither held out nor learned from; repeated rows are scored each; other columns
are ignored; an empty table gives an empty result; without training documents all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import crc_mod, load, written

OWN = 1023
BUCKETS = 1024
END = OWN + BUCKETS
SYMBOLS = END + 1
STATES = 8
ITERATIONS = 5
SEGMENT = 512
FREQUENT = 1 << 18
SEED = 11
#: Symbols handled at a time: in training with their forward values, in scoring without.
TRAIN_BATCH, SCORE_BATCH = 1 << 19, 1 << 22


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tb.pieces(batches, "text", 1 << 23):
        w = tb.words(*tb.text_buffer(tb.column(part, "text")))
        h, c = np.unique(w.hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tb.signed(h)), pa.array(c.astype(np.int64))], ["word", "c"])


class Lexicon:
    """Counts of the frequent words, symbols of the most frequent, and the buckets' weights."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, own: np.ndarray, bucket_log: np.ndarray):
        by = np.argsort(words)
        self.words, self.logs = words[by], np.log10(counts[by] + 0.1)
        self.symbol = np.full(len(words), -1, np.int32)
        at = np.searchsorted(self.words, own)
        self.symbol[at] = np.arange(len(own))
        self.bucket_log = bucket_log

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words (-1: none) and symbol of each word."""
        bucket = (h % np.uint64(BUCKETS)).astype(np.int32) + OWN
        if not len(self.words):
            return np.full(len(h), -1), bucket
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        at = np.where(self.words[at] == h, at, -1)
        own = np.where(at >= 0, self.symbol[at], -1)
        return at, np.where(own >= 0, own, bucket)


_MAIN = ["kind", "key", "doc_id", "held_out", "train", "n_words", "known", "base_log", "class_log", "symbols", "word", "tf"]


def _looked_up(shipped):
    """Per document its symbols and the sums over its frequent words; its other words as rows of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shipped.value
        task = TaskContext.get()
        key = (task.partitionId() if task else 0) << 36
        for part in tb.pieces(batches, "text"):
            w = tb.words(*tb.text_buffer(tb.column(part, "text")))
            m = part.num_rows
            at, symbol = lexicon.look_up(w.hashes)
            row = np.repeat(np.arange(m), w.counts)
            common = at >= 0
            log = np.where(common, lexicon.logs[at] if len(lexicon.logs) else 0.0, 0.0)
            shared = symbol >= OWN
            in_class = np.where(shared, log - lexicon.bucket_log[np.where(shared, symbol - OWN, 0)], 0.0)
            keys = key + np.arange(m)
            key += m
            symbols = symbol.astype("<u2")
            end = np.array([END], "<u2").tobytes()
            cells = [symbols[a:b].tobytes() + end for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist(), strict=True)]

            def total(x, row=row, m=m):
                return np.bincount(row, weights=x, minlength=m)

            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), pa.array(keys), tb.column(part, "doc_id"), tb.column(part, "held_out"), tb.column(part, "train"),
                 pa.array(w.counts.astype(np.int64)), pa.array(total(common).astype(np.int64)), pa.array(total(log)), pa.array(total(in_class)),
                 pa.array(cells, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], _MAIN)
            rare = np.flatnonzero(~common)
            if len(rare):
                by = rare[np.lexsort((w.hashes[rare], row[rare]))]
                first = np.flatnonzero(np.concatenate(([True], (w.hashes[by][1:] != w.hashes[by][:-1]) | (row[by][1:] != row[by][:-1]))))
                n = len(first)
                no = [pa.nulls(n, k) for k in (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(n, np.int32)), pa.array(keys[row[by[first]]]), *no, pa.array(tb.signed(w.hashes[by[first]])),
                     pa.array(np.diff(np.append(first, len(by))))], _MAIN)
    return run


# ---- the model -----------------------------------------------------------------------------

class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move = start, move
        self.emit = np.ascontiguousarray(emit.T)  # a row per symbol

    @classmethod
    def first(cls, symbol_counts: np.ndarray) -> Hmm:
        rng = np.random.default_rng(SEED)
        emit = (symbol_counts + 0.1) * np.exp(rng.standard_normal((STATES, SYMBOLS)))
        move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def from_counts(cls, sums: np.ndarray) -> Hmm:
        s, m, e = sums[:STATES] + 0.1, sums[STATES:STATES + STATES ** 2].reshape(STATES, STATES) + 0.1, sums[STATES + STATES ** 2:].reshape(STATES, SYMBOLS) + 0.01
        return cls(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=1, keepdims=True))


def _side_by_side(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, longest first, step by step: all symbols, the number of texts at each step, the order."""
    lens = np.array([len(x) for x in texts])
    order = np.argsort(-lens, kind="stable")
    live = np.searchsorted(-lens[order], -np.arange(lens.max()), side="left")  # texts longer than t
    offs = np.concatenate(([0], np.cumsum(live)))
    flat = np.concatenate([texts[i] for i in order.tolist()])
    step = np.concatenate([np.arange(n) for n in lens[order].tolist()])
    rank = np.repeat(np.arange(len(texts)), lens[order])
    out = np.empty(len(flat), np.int64)
    out[offs[step] + rank] = flat
    return out, live, order


def log_likelihoods(model: Hmm, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence, by the scaled forward recursion."""
    symbols, live, order = _side_by_side(texts)
    total = np.zeros(len(texts))
    at, alpha = 0, None
    for k in live.tolist():
        alpha = (model.start if alpha is None else alpha[:k] @ model.move) * model.emit[symbols[at:at + k]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:k] += np.log(scale)
        at += k
    out = np.empty(len(texts))
    out[order] = total
    return out


def expected_counts(model: Hmm, texts: list[np.ndarray]) -> np.ndarray:
    """Expected starts, moves and emissions, in one vector."""
    symbols, live, _ = _side_by_side(texts)
    offs = np.concatenate(([0], np.cumsum(live)))
    emit = model.emit[symbols]
    alpha, scale = np.empty((len(symbols), STATES)), np.empty(len(symbols))
    for t, k in enumerate(live.tolist()):
        a, b = offs[t], offs[t] + k
        now = (model.start if t == 0 else alpha[offs[t - 1]:offs[t - 1] + k] @ model.move) * emit[a:b]
        scale[a:b] = now.sum(axis=1)
        alpha[a:b] = now / scale[a:b, None]
    moves = np.zeros((STATES, STATES))
    beta = np.ones((live[-1], STATES))
    for t in range(len(live) - 1, 0, -1):
        a, k, prev = offs[t], live[t], offs[t - 1]
        back = emit[a:a + k] * beta / scale[a:a + k, None]
        moves += alpha[prev:prev + k].T @ back
        alpha[a:a + k] *= beta  # now the state probabilities at t
        beta = np.ones((live[t - 1], STATES))
        beta[:k] = back @ model.move.T
    alpha[:live[0]] *= beta
    emitted = np.stack([np.bincount(symbols, weights=alpha[:, s], minlength=SYMBOLS) for s in range(STATES)])
    return np.concatenate((alpha[:live[0]].sum(axis=0), (moves * model.move).ravel(), emitted.ravel()))


def _expected(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums, held, size = shipped.value, np.zeros(STATES + STATES ** 2 + STATES * SYMBOLS), [], 0
        for batch in batches:
            for cell in tb.column(batch, "symbols"):
                x = np.frombuffer(cell.as_buffer(), "<u2")
                for s in range(0, len(x), SEGMENT):
                    held.append(x[s:s + SEGMENT])
                    size += len(held[-1])
                    if size >= TRAIN_BATCH:
                        sums += expected_counts(model, held)
                        held, size = [], 0
        if held:
            sums += expected_counts(model, held)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], ["place", "value"])
    return run


def _scored(shipped):
    names = ["key", "log10"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, held, size = shipped.value, [], [], 0
        for batch in batches:
            for key, cell in zip(tb.column(batch, "key").to_pylist(), tb.column(batch, "symbols"), strict=True):
                keys.append(key)
                held.append(np.frombuffer(cell.as_buffer(), "<u2"))
                size += len(held[-1])
                if size >= SCORE_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(log_likelihoods(model, held) / np.log(10))], names)
                    keys, held, size = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(log_likelihoods(model, held) / np.log(10))], names)
    return run


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words with the highest counts, FREQUENT at most."""
    sizes = sorted(((int(r["p"]), r["count"]) for r in counts.groupBy(F.floor(F.log2("c")).alias("p")).count().collect()), reverse=True)
    least, total = None, 0
    for p, n in sizes:  # at most 64 rows
        total += n
        if total > FREQUENT:
            break
        least = 1 << p
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.where(F.col("c") >= least).toPandas()
    return rows["word"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)


def train(symbols: DataFrame, first: Hmm, iterations: int = ITERATIONS) -> Hmm:
    """Baum-Welch over rows of ``symbols`` (binary, two bytes each)."""
    sc, model = symbols.sparkSession.sparkContext, first
    for _ in range(iterations):
        shipped = sc.broadcast(model)
        rows = symbols.select("symbols").mapInArrow(_expected(shipped), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        sums = np.zeros(STATES + STATES ** 2 + STATES * SYMBOLS)  # one row per place
        sums[rows["place"].to_numpy(np.int64)] = rows["value"].to_numpy(np.float64)
        model = Hmm.from_counts(sums)
        shipped.unpersist()
    return model


def scored_documents(docs: DataFrame, parts: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document;
    crc32(doc_id) modulo ``parts`` is 0 for those held out."""
    sc = docs.sparkSession.sparkContext
    mod = crc_mod(parts)
    rows = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(mod == 0, F.lit(False))).withColumn("train", F.coalesce(mod != 0, F.lit(False)))
    counts = written(rows.where("train").select("text").mapInArrow(_word_counts, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    totals = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = rows.where("train").count()
    n_all, distinct = totals[1] + ends, totals[0] + (ends > 0)

    words, freq = _frequent(counts)
    top = np.lexsort((words, -freq))[:OWN]
    own = words[top]
    # weights of the buckets: at most BUCKETS rows
    by_bucket = (counts.where(~F.col("word").isin([int(x) for x in tb.signed(own)]) if len(own) else F.lit(True))
                 .groupBy(_bucket(F.col("word")).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect())
    mass, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in by_bucket:
        mass[r["b"]], kinds[r["b"]] = r["c"], r["v"]
    lexicon = Lexicon(words, freq, own, np.log10(mass + 0.1 * (kinds + 1)))
    symbol_counts = np.concatenate((freq[top], np.zeros(OWN - len(top)), mass, [ends]))

    found = written(rows.mapInArrow(_looked_up(sc.broadcast(lexicon)), "kind int, key long, doc_id long, held_out boolean, train boolean, n_words long, "
                                    "known long, base_log double, class_log double, symbols binary, word long, tf long"), "lm-documents", by="kind")
    main = found.where("kind = 0")
    rare = (found.where("kind = 1").select("key", "word", "tf").join(counts, "word", "left")
            .groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))).alias("rare_known"),
                                F.sum(F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.1)).alias("rare_log")))
    model = train(main.where("train"), Hmm.first(symbol_counts))
    likelihood = main.select("key", "symbols").mapInArrow(_scored(sc.broadcast(model)), "key long, log10 double")
    n_tokens = F.col("n_words") + 1
    known = F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if ends else 0)
    logs = F.coalesce("rare_log", F.lit(0.0))
    norm = float(np.log10(n_all + 0.1 * (distinct + 1)))
    return (main.drop("symbols", "word", "tf", "kind").join(rare, "key", "left").join(likelihood, "key")
            .select("doc_id", "held_out", n_tokens.alias("n_tokens"), known.alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
                    (F.col("base_log") + logs + float(np.log10(ends + 0.1)) - n_tokens * norm).alias("base_score"),
                    (F.col("log10") + F.col("class_log") + logs).alias("score")))


def _bucket(word):
    """The word's hash, as an unsigned number, modulo BUCKETS (a power of two)."""
    return word.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(load(spark, sf_dir, "documents"))
