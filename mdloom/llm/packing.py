"""Best-fit packing in rounds of a tree (operator 8).

Documents are tokenised, ended by an id, and cut into pieces of at most
``capacity`` tokens. Pieces are dealt by a hash to groups of about ``GROUP``
pieces. In each group the pieces, longest first, go to the open sequence with
the least room that takes them. Nearly full sequences are final; the others
become single items, and ``FAN_IN`` groups at a time are merged for another
round of best fit, until one group is left or ``ROUNDS`` rounds are done. A
group's size is bounded by GROUP * FAN_IN**ROUNDS pieces at any size of input,
so no round gathers the whole in one task. Every round is written to the shared
folder, so ids of sequences stay the same if a task is repeated.

Results for odd input: null and empty texts are one piece of the end id alone;
a null doc_id is kept; repeated rows are packed each (told apart by their place
in the order of the group); other columns are ignored; an empty table gives an
empty result; a text of any length is cut, never dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import load, written
from mdloom.llm.tokenwords import encoder, forget, tokenizer_path

GROUP = 20_000
FAN_IN = 4
ROUNDS = 3
#: Bytes of text tokenised at once.
STEP = 1 << 20
#: A sequence with less room than this share of its capacity is final.
NEARLY = 0.002
_ROW = "home long, bin long, done boolean, doc_id long, piece int, start long, length int, ids_crc32 long, offset long"


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], "<u4")
        for part in tb.pieces(batches, "text", STEP):
            ids, counts = enc.encode(*tb.text_buffer(tb.column(part, "text")))
            docs, out, at = tb.column(part, "doc_id").to_pylist(), [], 0
            for doc, n in zip(docs, counts.tolist(), strict=True):
                own = np.concatenate((ids[at:at + n].astype("<u4"), end))
                at += n
                for i, s in enumerate(range(0, n + 1, capacity)):
                    cut = own[s:s + capacity]
                    out.append((doc, i, s, len(cut), zlib.crc32(cut.tobytes())))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
        forget()
    return run


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(path, end_id, capacity), "doc_id long, piece int, start long, length int, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For items given longest first: bin and place in it of each item, and the room left in each bin."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    have = 0  # bit r: some bin has room r
    room: list[int] = []
    bins, places = [], []
    for size in sizes:
        fits = have >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = open_[r].pop()
            if not open_[r]:
                have ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins.append(b)
        places.append(capacity - r)
        r -= size
        room[b] = r
        if r:
            open_[r].append(b)
            have |= 1 << r
    return bins, places, room


def _round(capacity: int, level: int):
    """Best fit of a group's bins; rows of one bin move together."""
    least = max(1, int(capacity * NEARLY))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", "offset"], kind="stable").reset_index(drop=True)
        first = np.flatnonzero(np.concatenate(([True], rows["bin"].to_numpy()[1:] != rows["bin"].to_numpy()[:-1])))
        item = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        size = np.add.reduceat(rows["length"].to_numpy().astype(np.int64), first)
        by = np.argsort(-size, kind="stable")
        bins, places, room = best_fit(size[by].tolist(), capacity)
        new, place = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        new[by], place[by] = bins, places
        done = np.asarray(room, np.int64)[new] < least
        home = int(key[0])
        tb.release()
        return pd.DataFrame({
            "home": home, "bin": (np.int64(level) << 58) | (np.int64(home) << 26) | new[item], "done": done[item],
            "doc_id": rows["doc_id"].astype("Int64"), "piece": rows["piece"], "start": rows["start"], "length": rows["length"],
            "ids_crc32": rows["ids_crc32"], "offset": rows["offset"].to_numpy() + place[item]})
    return run


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    table = written(pieces, "pieces")
    groups = max(1, -(-table.count() // GROUP))
    key = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    # the table is written, so a repeated task finds its rows at the same places
    first = (table.withColumn("home", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
             # equal rows (a repeated document) are items of their own, in an order that repeats
             .select("home", key.alias("bin"), F.lit(False).alias("done"), "doc_id", "piece", "start", "length", "ids_crc32",
                     F.lit(0).cast("long").alias("offset")))
    level, ready = 0, None
    rows = written(first.groupBy("home").applyInPandas(_numbered(_round(capacity, 0)), _ROW), "pack-round")
    while True:
        final = groups <= 1 or level >= ROUNDS
        out = rows if final else rows.where("done")
        ready = out if ready is None else ready.unionByName(out)
        if final:
            return ready.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                                F.col("bin").alias("sequence_id"), "offset")
        level += 1
        groups = -(-groups // FAN_IN)
        rows = written(rows.where("not done").withColumn("home", F.floor(F.col("home") / FAN_IN))
                       .groupBy("home").applyInPandas(_round(capacity, level), _ROW), "pack-round")


def _numbered(fn):
    """For the first round every row is an item: numbered in an order that does not depend on arrival."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "bin", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        rows["bin"] = np.arange(len(rows))
        return fn(key, rows)
    return run


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(pieces_of(docs, path or tokenizer_path("word_bpe_49k.json"), end_id, capacity), capacity)


def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
