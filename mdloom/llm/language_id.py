"""Nearest-centroid language identification (operator 6).

Features are byte n-grams (1 to 3 bytes of the lower-cased text, all ASCII but
letters as blanks), hashed into ``FEATURES`` counts and weighted by inverse
document frequency; vectors have length one. Each language gets ``CENTROIDS``
centroids by spherical k-means; a text goes to the language of the nearest one
by cosine, and is rejected where that cosine is below the floor of its language
for texts of its length. Short texts lie further from any centroid by chance, so
floors are told by classes of length (doublings of the number of n-grams, the
last without an end): a low quantile of the cosines of the sample's texts and of
passages cut from them at the lower end of each class.

Document frequencies are counted over every labelled training text. The
centroids are fitted on a sample chosen by a hash of doc_id: about
``SAMPLE`` documents per language at most, the documented bound of the fit.
The number of languages is taken to be small: the model (CENTROIDS vectors per
language) is held by the driver and each task.

Results for odd input: null texts and texts without a letter are ``und`` with
score 0 and rejected; texts of one word are predicted like others; null labels
and null doc_ids are never learned from; repeated rows get equal results; other
columns are ignored; without any training row all is ``und``, and only texts without a letter are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdloom.llm import textbatch as tb
from mdloom.llm.common import crc_mod, load

FEATURES = 1 << 13
#: Bytes whose n-grams are held at once.
STEP = 1 << 20
#: Texts whose counts are held at once.
ROWS = 128
CENTROIDS = 4
SAMPLE = 2000
ROUNDS = 10
#: The floor is the cosine that all but this share of the texts and passages of a class reach, less one part in
#: the square root of their number.
FLOOR_SHARE = 0.01
#: Classes of length: 2**c n-grams or more, of which those from FIRST on have floors; in the last also all longer texts.
FIRST, CLASSES = 3, 13
#: A class with fewer texts and passages has the floor of the class before (0 before the first).
FEW = 10

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[:128] = 32
_BLANK[97:123] = np.arange(97, 123)


def counts(texts: pa.Array) -> np.ndarray:
    """One row of n-gram counts per text."""
    data, offs = tb.text_buffer(pc.utf8_lower(texts.fill_null("")))
    out = np.zeros((len(texts), FEATURES), np.float32)
    if not len(data):
        return out
    x = _BLANK[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)  # blanks in a row count once
    keep[offs[:-1][offs[:-1] < len(x)]] = True
    offs = np.concatenate(([0], np.cumsum(keep)))[offs]
    x = x[keep]
    at = 0
    while at < len(texts):  # rows of about STEP bytes together; a longer row alone, in steps
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + STEP, side="right")) - 1)
        for s in range(int(offs[at]), int(offs[end]), STEP):
            e = min(s + STEP, int(offs[end]))
            h = _grams(x[s:e + 2])
            for i in range(at, end):
                a, b, stop = max(s, int(offs[i])), min(e, int(offs[i + 1])), int(offs[i + 1])
                if b > a:
                    own = np.concatenate([g[a - s:max(a, min(b, stop - n)) - s] for n, g in enumerate(h)])
                    out[i] += np.bincount(own, minlength=FEATURES)
        at = end
    return out


def _grams(x: np.ndarray) -> list[np.ndarray]:
    """The features of the 1, 2 and 3 bytes from each place on (the last places lack the longer ones)."""
    x = x.astype(np.uint32)
    shift = 32 - (FEATURES.bit_length() - 1)
    two = np.zeros(len(x), np.uint32)
    two[:-1] = (x[:-1] << 8 | x[1:]) + (1 << 16)
    three = np.zeros(len(x), np.uint32)
    three[:-2] = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) + (1 << 25)
    return [(g * np.uint32(0x9E3779B1)) >> np.uint32(shift) for g in (x, two, three)]


def weighted(raw: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Rows of length one; ``out`` may be ``raw`` itself."""
    x = np.multiply(raw, idf, out=out)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    x /= np.where(norm > 0, norm, 1)
    return x


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for part in _rows(batches):
        raw = counts(tb.column(part, "text"))
        df += (raw > 0).sum(axis=0)
        n += part.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(np.append(df, n))], ["feature", "df"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tb.pieces(batches, "text"):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def length_class(grams: np.ndarray) -> np.ndarray:
    return np.clip(np.frexp(grams)[1] - 1, 0, CLASSES - 1)


def _passages(texts: list[str], places: list[int], kind: int) -> tuple[list[int], list[str]]:
    """Of each text long enough, a passage of about 2**kind n-grams (three per character) from a place of its own."""
    size = (1 << kind) * 35 // 100 + 1
    long = [i for i, t in enumerate(texts) if len(t) >= size]
    starts = [(places[i] * 0x9E3779B1 + kind * 0x85EBCA6B >> 7) % (len(texts[i]) - size + 1) for i in long]
    return long, [texts[i][a:a + size] for i, a in zip(long, starts, strict=True)]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each text, and of its passages (class of length, or -1 for the text)."""
    for part in _rows(batches):
        langs, places, texts = (tb.column(part, c).to_pylist() for c in ("lang", "place", "text"))
        for kind in (-1, *range(FIRST, CLASSES)):
            rows, cut = (range(len(texts)), texts) if kind < 0 else _passages(texts, places, kind)
            raw = counts(pa.array(cut, tb.column(part, "text").type))
            at = [np.flatnonzero(r).astype(np.int32) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in rows], pa.string()), pa.array([places[i] for i in rows], pa.int64()), pa.array([kind] * len(cut), pa.int32()),
                 pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(raw, at, strict=True)], pa.binary())],
                ["lang", "place", "kind", "at", "n"])


def _filled(rows: pd.DataFrame) -> np.ndarray:
    raw = np.zeros((len(rows), FEATURES), np.float32)
    for i, (a, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
        raw[i, np.frombuffer(a, np.int32)] = np.frombuffer(n, np.float32)
    return raw


def floors_of(cosines: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The floor of each class of length."""
    out, kinds = np.zeros(CLASSES), length_class(grams)
    for c in range(FIRST, CLASSES):
        own = cosines[kinds == c]
        out[c] = out[c - 1] if len(own) < FEW else float(np.quantile(own, FLOOR_SHARE, method="lower")) * (1 - len(own) ** -0.5)
    return out


def _fit(idf: np.ndarray):
    """Spherical k-means of one language's sample, at most about SAMPLE rows."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "place"], kind="stable")
        whole = rows[rows["kind"] < 0]
        cut = rows[rows["kind"] >= 0]
        raw = _filled(whole)
        grams = [raw.sum(axis=1)]
        x = weighted(raw, idf, out=raw)
        k = min(CENTROIDS, len(x))
        picked = [0]  # start: each next centre is the row furthest from those so far
        best = x @ x[0]
        for _ in range(k - 1):
            picked.append(int(best.argmin()))
            best = np.maximum(best, x @ x[picked[-1]])
        centres = x[picked]
        for _ in range(ROUNDS):
            own = (x @ centres.T).argmax(axis=1)
            member = (own == np.arange(k)[:, None]).astype(np.float32)
            sums = np.where(member.any(axis=1)[:, None], member @ x, centres)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = sums / np.where(norm > 0, norm, 1)
        cosines = [(x @ centres.T).max(axis=1)]
        del x, raw
        for i in range(0, len(cut), ROWS):
            part = _filled(cut.iloc[i:i + ROWS])
            grams.append(part.sum(axis=1))
            cosines.append((weighted(part, idf, out=part) @ centres.T).max(axis=1))
        floors = floors_of(np.concatenate(cosines), np.concatenate(grams))
        tb.release()
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": range(k), "vector": [c.astype(np.float32).tobytes() for c in centres],
                             "floors": [floors.tolist()] * k})
    return run


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, centres: np.ndarray, floors: np.ndarray):
        self.langs, self.idf, self.centres, self.floors = langs, idf, centres, floors

    def predict(self, raw: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        near = weighted(raw, self.idf) @ self.centres.T
        best = near.argmax(axis=1)
        score = near[np.arange(len(near)), best].astype(np.float64)
        return [self.langs[i] for i in best], np.clip(score, 0, 1), score < self.floors[best, length_class(raw.sum(axis=1))]


def fit(docs: DataFrame, train: Column) -> Model | None:
    """Learn from the rows of docs (doc_id, text, lang) where ``train`` holds and lang is not null."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    freq = rows.select("text").mapInArrow(_document_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(FEATURES + 1, np.int64)
    for r in freq:  # FEATURES + 1 rows
        df[r["feature"]] = r["df"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    place = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 31))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, SAMPLE / n) * (1 << 31)))])
    sample = rows.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col("lang"))).select("lang", "place", "text")
    found = (sample.mapInArrow(_sparse, "lang string, place long, kind int, at binary, n binary").groupBy("lang")
             .applyInPandas(_fit(idf), "lang string, centroid int, vector binary, floors array<double>").orderBy("lang", "centroid").collect())
    if not found:
        return None
    return Model([r["lang"] for r in found], idf, np.stack([np.frombuffer(r["vector"], np.float32) for r in found]),
                 np.array([r["floors"] for r in found]))


ADDED = ("lang_pred", "score", "rejected")


def _predicted(shipped, suffix: str = ""):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for part in _rows(batches):
            lettered = tb.column(part, "_lettered").to_numpy(zero_copy_only=False)
            m = part.num_rows
            langs, score, low = ["und"] * m, np.zeros(m), ~lettered
            if model is not None and lettered.any():
                langs, score, low = model.predict(counts(tb.column(part, "text")))
                langs = [x if ok else "und" for x, ok in zip(langs, lettered, strict=True)]
                score, low = np.where(lettered, score, 0.0), low | ~lettered
            keep = [i for i, c in enumerate(part.schema.names) if c != "_lettered"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(langs), pa.array(score), pa.array(low)],
                                             [*(part.schema.names[i] for i in keep), *(c + suffix for c in ADDED)])
    return run


def identify(docs: DataFrame, model: Model | None, keep: list[str], suffix: str = "") -> DataFrame:
    """The columns ``keep`` of docs (text may be one of them) with lang_pred, score and rejected
    (each with ``suffix``, for tables that have such columns)."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    cols = [c for c in keep if c != "text"]
    added = [c + suffix for c in ADDED]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    taken = docs.select(*[f"`{c}`" for c in cols], "text")
    schema = T.StructType(taken.schema.fields + [T.StructField(c, k) for c, k in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)])
    predicted = taken.select("*", lettered).mapInArrow(_predicted(shipped, suffix), schema)
    return predicted.select(*[f"`{c}`" for c in keep], *added)


def known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are not rejected, with their columns, whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    inner = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(True)
    found = identify(docs.select(inner.alias("row"), "text"), model, ["row", "text"])
    return found.where(~F.col("rejected")).select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def train_rows() -> Column:
    """crc32(doc_id as text) modulo 4 is not 2; a null doc_id is never learned from."""
    return F.coalesce(crc_mod(4) != 2, F.lit(False))


def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = docs.withColumn("held_out", F.coalesce(crc_mod(4) == 2, F.lit(False)))
    return identify(held, fit(docs.select("doc_id", "text", "lang"), train_rows()), ["doc_id", "held_out"])
