"""Divergence of a language's sources by their terms, with late strings (operator 13).

A term is a run of letters (A-Z lower-cased, every byte from 0x80 on a letter). Of each
language the terms of at least ``least_docs`` of its documents are kept. Every
(language, source) group and every language give each kept term
p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), N the group's occurrences of kept terms, V their number.

1. One pass over the texts counts terms per group. A term is a 64-bit digest
   from then on; beside a task's counts stand dictionaries of its batches: per digest the
   least and the greatest string. Only counts by digest are shuffled.
2. Of the dictionaries only the digests that are kept somewhere are read (a bitmap of fixed
   size tells most others apart before anything is shuffled). Where the least and the greatest string
   of a digest differ, several terms share it: its counts are taken anew from the texts by
   digest and string, and each string goes on as a term of its own.
3. Values are made and ranked by digests. Text is joined only to the terms that a
   group may return: those not below its ``most``-th largest value.

The sum of |p - q| over all kept terms for two sources is made per language and bucket
of terms: a bucket's groups stand as a matrix of bounded size, in which a missing
count has its group's p of zero; partial sums are added up. A term's rows are as many
as its language has sources, so no bucket is a hot key.

Arithmetic is exact: quotients by three steps of long division in whole numbers (right
up to 9 * 10**15 occurrences), sums in long. ``p`` sums of two sources stay below 2 * 10**9 per term.

Results for odd input: a null text, lang or source is an empty one; empty texts and texts without
letters make their group occur, with count 0 for all terms; repeated rows and null doc_ids are
documents like others; ties are ranked by the UTF-8 bytes of the item; a language without kept
terms has pairs of value 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import load, written

U64 = np.uint64
LEAST_DOCS = 30
MOST = 50
#: Values of kept terms in a bucket, on average.
BUCKET = 1 << 16
#: Cells of the matrix that a bucket fills at once, and sources compared with all others at once.
CELLS, SOURCES = 1 << 20, 1 << 10
#: Slots of the bitmap of kept digests.
SLOTS = 1 << 24
#: Bits of a digest; tests take fewer, so that terms share them.
DIGEST_BITS = 64
#: Rows of counts that a task gathers before it hands them on.
HELD = 3 << 18

#: A term is a run of letters and all bytes from 0x80 on.
IS_GAP = np.ones(256, dtype=bool)
IS_GAP[65:91] = IS_GAP[97:123] = IS_GAP[128:] = False

_COUNTED = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()),
                      ("least", pa.string()), ("most", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNTED_SQL = "kind int, lang string, source string, digest long, least string, most string, n long, docs long"


def _terms(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, tb.Words]:
    """Digest and row of every term of a batch."""
    w = tb.words(data, offs, IS_GAP)
    digest = w.hashes if bits == 64 else w.hashes & U64((1 << bits) - 1)
    return digest, np.repeat(np.arange(len(offs) - 1), w.counts), w


def _strings(data: np.ndarray, w: tb.Words, rows: np.ndarray) -> pa.Array:
    """The lower-cased strings of the words at ``rows``."""
    size = (w.ends - w.starts)[rows]
    offs = np.concatenate(([0], np.cumsum(size)))
    place = np.repeat(w.starts[rows] - offs[:-1], size) + np.arange(offs[-1])
    return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(tb.LOWER[data[place]].tobytes())).cast(pa.string())


def _extremes(data: np.ndarray, w: tb.Words, by: np.ndarray, ordered: np.ndarray) -> pa.Table:
    """Each digest of a batch with the least string that has it there, and the greatest (null: the same). ``by``
    are the words in the order of their digests ``ordered``.

    All occurrences are compared byte by byte with the first one of their digest; only where
    one differs are the strings of the digest made and put in order."""
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    head = by[np.repeat(first, np.diff(np.append(first, len(by))))]
    size = w.ends - w.starts
    differ = size[by] != size[head]
    alike = np.flatnonzero(~differ & (by != head))
    at = 0
    total = np.cumsum(size[by[alike]]) if len(alike) else np.empty(0, np.int64)
    while at < len(alike):  # a bounded number of bytes at a time
        done = int(total[at - 1]) if at else 0
        till = max(at + 1, int(np.searchsorted(total, done + tb.SLICE, side="right")))
        part = alike[at:till]
        length = size[by[part]]
        row = np.repeat(np.arange(len(part)), length)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        unlike = tb.LOWER[data[w.starts[by[part]][row] + inside]] != tb.LOWER[data[w.starts[head[part]][row] + inside]]
        differ[part[row[unlike]]] = True
        at = till
    table = pa.table({"digest": pa.array(ordered[first].view(np.int64)), "least": _strings(data, w, by[first]), "most": pa.nulls(len(first), pa.string())})
    if not differ.any():
        return table
    others = pa.table({"digest": pa.array(ordered[differ].view(np.int64)), "least": _strings(data, w, by[differ])})
    every = pa.concat_tables([table.select(["digest", "least"]), others]).group_by("digest").aggregate([("least", "min"), ("least", "max")])
    least, most = every.column("least_min"), every.column("least_max")
    return pa.table({"digest": every.column("digest"), "least": least, "most": pc.if_else(pc.equal(least, most), pa.scalar(None, pa.string()), most)})


class _Counts:
    """Counts of a task, summed up over its batches and handed on when they are many."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[np.ndarray] = []  # (group, digest, n, docs) as columns
        self.rows = 0

    def add(self, group: np.ndarray, digest: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.stack([group, digest.view(np.int64), n, docs]))
        self.rows += len(group)
        if self.rows > 2 * HELD:
            self.parts = [self._summed()]
            self.rows = self.parts[0].shape[1]
            if self.rows > HELD:
                yield from self.batches()

    def _summed(self) -> np.ndarray:
        group, digest, n, docs = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((4, 0), np.int64)
        by = np.lexsort((digest, group))
        group, digest, n, docs = group[by], digest[by], n[by], docs[by]
        new = np.ones(len(by), bool)
        new[1:] = (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return np.zeros((4, 0), np.int64)
        return np.stack([group[first], digest[first], np.add.reduceat(n, first), np.add.reduceat(docs, first)])

    def names(self) -> tuple[pa.Array, pa.Array]:
        names = list(self.groups)
        return pa.array([a for a, _ in names], pa.string()), pa.array([b for _, b in names], pa.string())

    def batches(self) -> Iterator[pa.RecordBatch]:
        group, digest, n, docs = self._summed()
        self.parts, self.rows = [], 0
        lang, source = self.names()
        for a in range(0, len(group), 1 << 16):
            cut = slice(a, a + (1 << 16))
            at = pa.array(group[cut])
            yield _rows(0, len(at), lang=lang.take(at), source=source.take(at), digest=pa.array(digest[cut]), n=pa.array(n[cut]), docs=pa.array(docs[cut]))


def _rows(kind: int, size: int, **cols: pa.Array) -> pa.RecordBatch:
    cols["kind"] = pa.array(np.full(size, kind, np.int32))
    return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(size, f.type) for f in _COUNTED], schema=_COUNTED)


def _counted(bits: int):
    """Rows of kind 0: counts and numbers of documents per group and digest, of a task or a large part of it; kind 1: least
    and greatest string per digest of a batch; kind 2: the groups that occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for part in tb.pieces(batches, "text"):
            groups = counts.groups
            of = np.array([groups.setdefault(g, len(groups)) for g in zip(tb.column(part, "lang").to_pylist(), tb.column(part, "source").to_pylist(), strict=True)], np.int64)
            # texts stand by group, so that one stable sort by digest leaves groups, and documents in them, together
            order = np.argsort(of, kind="stable")
            of = of[order]
            data, offs = tb.text_buffer(tb.column(part, "text").take(pa.array(order)))
            digest, row, w = _terms(data, offs, bits)
            if not len(digest):
                continue
            by = np.argsort(digest, kind="stable")
            d, r = digest[by], row[by]
            new = np.ones(len(by), bool)
            new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
            doc = np.flatnonzero(new)  # where a document's words of a digest begin
            g, e = of[r[doc]], d[doc]
            new = np.ones(len(doc), bool)
            new[1:] = (e[1:] != e[:-1]) | (g[1:] != g[:-1])
            first = np.flatnonzero(new)  # and a group's documents
            yield from counts.add(g[first], e[first], np.diff(np.append(doc[first], len(by))), np.diff(np.append(first, len(doc))))
            for batch in _extremes(data, w, by, d).combine_chunks().to_batches(max_chunksize=1 << 16):
                yield _rows(1, len(batch), **{c: tb.column(batch, c) for c in ("digest", "least", "most")})
        yield from counts.batches()
        lang, source = counts.names()
        yield _rows(2, len(lang), lang=lang, source=source)
    return run


def _split(bits: int, shipped):
    """The terms whose digest is in the bitmap, by document: counts per (lang, source, digest, string) of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped.value
        for part in tb.pieces(batches, "text"):
            data, offs = tb.text_buffer(tb.column(part, "text"))
            digest, row, w = _terms(data, offs, bits)
            at = np.flatnonzero(_in(bitmap, digest))
            lang, source = tb.column(part, "lang"), tb.column(part, "source")
            rows = pa.array(row[at])
            table = pa.table({"row": rows, "lang": lang.take(rows), "source": source.take(rows), "digest": pa.array(digest[at].view(np.int64)),
                              "term": _strings(data, w, at)})
            per_doc = table.group_by(["row", "lang", "source", "digest", "term"]).aggregate([([], "count_all")])
            out = per_doc.group_by(["lang", "source", "digest", "term"]).aggregate([("count_all", "sum"), ([], "count_all")])
            yield from out.select(["lang", "source", "digest", "term", "count_all_sum", "count_all"]).rename_columns(
                ["lang", "source", "digest", "term", "n", "docs"]).to_batches()
    return run


def _slot(digest: Column) -> Column:
    return F.pmod(digest, F.lit(SLOTS)).cast("int")


def _bitmap(digests: DataFrame) -> np.ndarray:
    """Whatever the number of digests, at most SLOTS / 8 bytes come back: slots are put together in words of 8,192 by the tasks."""
    words = (digests.select(_slot(F.col("digest")).alias("slot")).distinct()
             .groupBy(F.shiftright("slot", 13).alias("word")).agg(F.collect_set(F.col("slot").bitwiseAND(8191).cast("short")).alias("bits")))
    bits = np.zeros(SLOTS >> 3, np.uint8)
    for r in words.toLocalIterator():
        slots = (r["word"] << 13) + np.array(r["bits"], np.int64)
        np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return bits


def _in(bitmap: np.ndarray, digest: np.ndarray) -> np.ndarray:
    slot = np.mod(digest.view(np.int64), SLOTS)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _filtered(shipped):
    """Rows whose digest is in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = tb.column(batch, "digest").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(_in(shipped.value, digest)))
    return run


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (n + 5 v)): long division, three decimal digits at a time."""
    top, bottom = (count + 5).cast("long"), (n + 5 * v).cast("long")
    whole = F.lit(0).cast("long")
    for _ in range(3):
        top = top * 1000
        whole = whole * 1000 + F.call_function("div", top, bottom)
        top = top % bottom
    return 1 + whole


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int = DIGEST_BITS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """groups (lang, source); counts (lang, source, term_id, n) and totals (lang, term_id, n) of kept terms; strings
    (term_id, term) of all kept terms. ``term_id`` is the digest, and where several terms share one, the digest and the term."""
    spark = docs.sparkSession
    texts = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("text", "lang", "source")])
    pass_one = written(texts.mapInArrow(_counted(bits), _COUNTED_SQL), "terms")
    groups = written(pass_one.where("kind = 2").select("lang", "source").distinct(), "term-groups")
    by_digest = written(pass_one.where("kind = 0").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    often = written(by_digest.groupBy("lang", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs), "term-kept")
    bitmap = spark.sparkContext.broadcast(_bitmap(often))
    found = (pass_one.where("kind = 1").select("digest", "least", "most").mapInArrow(_filtered(bitmap), "digest long, least string, most string")
             .groupBy("digest").agg(F.min("least").alias("least"), F.max(F.coalesce("most", "least")).alias("most")))
    strings = written(found.join(often.select("digest").distinct(), "digest", "left_semi"), "term-strings")
    shared = strings.where("least < most").select("digest")
    single = (strings.where("least = most").select(_id(F.col("digest")).alias("term_id"), F.col("least").alias("term")))
    counts = by_digest.join(often.select("lang", "digest"), ["lang", "digest"], "left_semi").select("lang", "source", "digest", "n")
    totals = often.select("lang", "digest", "n")
    if shared.isEmpty():
        plain = [t.withColumn("term_id", _id(F.col("digest"))).drop("digest") for t in (counts, totals)]
        return groups, written(plain[0], "kept-counts"), written(plain[1], "kept-totals"), single
    # several terms have one digest: count them anew, by digest and string
    marked = spark.sparkContext.broadcast(_bitmap(shared))
    anew = (texts.mapInArrow(_split(bits, marked), "lang string, source string, digest long, term string, n long, docs long")
            .join(shared, "digest", "left_semi").groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    anew = written(anew, "terms-apart")
    apart = written(anew.groupBy("lang", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs), "terms-apart-kept")
    own = _id(F.col("digest"), F.col("term"))

    def together(plain: DataFrame, split: DataFrame, cols: list[str]) -> DataFrame:
        one = plain.join(shared, "digest", "left_anti").withColumn("term_id", _id(F.col("digest")))
        return one.select(*cols).unionByName(split.withColumn("term_id", own).select(*cols))

    counts = together(counts, anew.join(apart.select("lang", "digest", "term"), ["lang", "digest", "term"], "left_semi"), ["lang", "source", "term_id", "n"])
    totals = together(totals, apart, ["lang", "term_id", "n"])
    strings = single.unionByName(apart.select(own.alias("term_id"), "term").distinct())
    return groups, written(counts, "kept-counts"), written(totals, "kept-totals"), strings


def _id(digest: Column, term: Column | None = None) -> Column:
    """A term's key: its digest, and its own string where others share that."""
    return F.struct(digest.alias("digest"), F.coalesce(term, F.lit("")).alias("apart") if term is not None else F.lit("").alias("apart"))


def _distances(rows: pa.Table) -> pa.Table:
    """A bucket of a language: its groups (digest null, their p of a zero count) and the p of counts over 0. Per pair
    of groups the sum of |p - q| less |zero p - zero q| over the bucket's terms, where that is not 0."""
    head = pc.is_null(rows.column("digest"))
    groups, cells = rows.filter(head), rows.filter(pc.invert(head))
    source, zero = groups.column("source").combine_chunks(), groups.column("p").to_numpy()
    out = []
    if len(cells):
        group = pc.index_in(cells.column("source"), value_set=source).to_numpy()
        digest = cells.column("digest").to_numpy()
        apart = cells.column("apart").combine_chunks().dictionary_encode().indices.to_numpy()
        by = np.lexsort((apart, digest))
        new = np.zeros(len(by), np.int64)
        new[1:] = (digest[by][1:] != digest[by][:-1]) | (apart[by][1:] != apart[by][:-1])
        term, group, p = np.cumsum(new), group[by], cells.column("p").to_numpy()[by]
        width = max(1, CELLS // len(zero))
        for a in range(0, len(zero), SOURCES):
            mine = np.arange(a, min(a + SOURCES, len(zero)))
            sums = np.zeros((len(mine), len(zero)), np.int64)
            for t in range(0, int(term[-1]) + 1, width):
                lo, hi = np.searchsorted(term, [t, t + width])
                m = np.repeat(zero[:, None], int(term[hi - 1]) - t + 1, axis=1)
                m[group[lo:hi], term[lo:hi] - t] = p[lo:hi]
                for i in mine.tolist():
                    sums[i - a] += np.abs(m - m[i]).sum(axis=1) - m.shape[1] * np.abs(zero - zero[i])
            i, j = np.nonzero(sums)
            out.append(pa.table({"source": source.take(pa.array(mine[i])), "item": source.take(pa.array(j)), "value": sums[i, j]}))
    every = pa.concat_tables(out) if out else pa.table({"source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    lang = pa.repeat(rows.column("lang")[0], len(every))
    return every.add_column(0, "lang", lang.cast(pa.string())).cast(_DISTANCES)


_DISTANCES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def pairs(groups: DataFrame, values: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language. ``groups`` has zero (p of count 0) and v, ``values`` p of all counts over 0."""
    buckets = max(-(-values.count() // BUCKET), 1)
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast("long").alias("digest"),
                          F.lit("").alias("apart"), "source", F.col("zero").alias("p"))
    cells = values.select("lang", F.pmod(F.xxhash64("term_id"), F.lit(buckets)).cast("int").alias("bucket"), "term_id.digest", "term_id.apart", "source", "p")
    parts = (heads.unionByName(cells).groupBy("lang", "bucket").applyInArrow(_distances, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    every = groups.select("lang", "source", "zero", "v").join(other, "lang").where(F.col("source") != F.col("item"))
    base = F.col("v") * F.abs(F.col("zero") - F.col("other_zero"))
    return (every.join(parts, ["lang", "source", "item"], "left")
            .select("lang", "source", "item", (base + F.coalesce("value", F.lit(0))).cast("long").alias("value")))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = MOST, bits: int = DIGEST_BITS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other
    one (part ``pair``), and by which terms it is above its language (``term``, at most ``most``)."""
    groups, counts, totals, strings = kept_terms(docs, least_docs, bits)
    of_lang = totals.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    sizes = (groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
             .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("group_n", "lang_n", "v")]))
    zero = F.when(F.col("v") > 0, probability(F.lit(0).cast("long"), F.col("group_n"), F.greatest("v", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    sizes = written(sizes.withColumn("zero", zero), "group-sizes")
    values = (counts.join(sizes.select("lang", "source", "group_n", "v"), ["lang", "source"])
              .select("lang", "source", "term_id", probability(F.col("n"), F.col("group_n"), F.col("v")).alias("p")))
    values = written(values, "group-values")
    general = totals.join(of_lang, "lang").select("lang", "term_id", probability(F.col("n"), F.col("lang_n"), F.col("v")).alias("q"))
    above = (values.join(general, ["lang", "term_id"]).where(F.col("p") > F.col("q"))
             .select("lang", "source", "term_id", (F.col("p") - F.col("q")).alias("value")))
    # by value alone first: ties at the limit all get their text, then the text decides
    near = above.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("r") <= most).drop("r")
    named = near.join(strings, "term_id").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    apart = pairs(sizes, values).withColumn("part", F.lit("pair"))
    return terms.unionByName(apart.withColumn("rank", F.row_number().over(order)).select(terms.columns))


def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
langs AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS n FROM groups g),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
      FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
