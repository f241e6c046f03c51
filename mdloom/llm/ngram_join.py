"""N-gram Jaccard join with several global token orders (operator 10).

Each document is the set of its distinct k-word shingles (64-bit hashes). Two
sets of similarity >= t share a token among the first |x| - ceil(t|x|) + 1 of
each *under every global order of the tokens*. Candidates must share such a
prefix token under the first order (a join on the token) and are dropped unless
they also share one under the second and the third (checked before the exact
intersection). All orders put frequent tokens last; ties fall by three seeded
hashes. Any order gives right results, so frequencies are only counted for
tokens that repeat inside a slice of the input, and the ``HOT_TOKENS`` most
frequent at most are shipped to the tasks.

Groups of copies stay linear:

* equal sets are one class (a 64-bit hash of the set); copies are never paired;
* in each bucket of a prefix token, every class is first compared with one class
  of its length range only (a star), the one with the least share of rare
  tokens: of a group of edited copies, the one that the others stem from.
  Components of these links settle most buckets; a class leaves its bucket if that
  comparison was the only one its length allows;
* only classes of one bucket that are still in different components are then
  compared, by the bound below and where it allows a link by their sets. Buckets
  with the same least class are joined into one, and those of more than ``BLOCK`` classes
  are cut into pairs of blocks, each a unit of work of bounded size. No link between
  different components is left out, so components are exact.

Before any set is shipped, a candidate must pass a bound on its overlap: each
class keeps the number of its tokens in each of about n/2 hash lanes, and the sum of
the lanes' minima is at least the true overlap. Only the sets of classes in
surviving pairs are made again from the texts (a bitmap of fixed size tells which).

Frequent tokens bypass the per-token pass: their rows are dealt by class and
meet only in aggregations and joins that AQE can split.

Results for odd input: null and empty texts, and texts without words, have an
empty set, link with nothing and are their own component; a null doc_id is kept
and sorts first where a smallest id is taken, so a component that holds one has
a null id only if all its ids are null; repeated rows are copies; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.llm import textbatch as tb
from mdloom.llm.common import load, text_key, whole_row, written
from mdloom.llm.components import connected

HOT_TOKENS = 1 << 18
HELD = 1 << 14
SEEDS = (0x51ED270B76A1F3C5, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
HOT_BIT = np.uint64(1) << np.uint64(63)


def _sig(s: np.ndarray) -> int:
    """Hash of a sorted set; order of the tokens does not matter."""
    return int(tb.mix(np.array([tb.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def needed(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - needed(n, num, den) + 1


def lanes(s: np.ndarray) -> bytes:
    """Numbers of tokens by hash lane, a power of two of lanes; empty if a lane's number needs more than a byte."""
    n = 1 << max(3, (len(s) // 2).bit_length())
    count = np.bincount(((s >> np.uint64(20)) & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return count.astype(np.uint8).tobytes() if count.max(initial=0) < 256 else b""


def may_link(x: bytes, y: bytes, num: int, den: int) -> bool:
    """False only if the overlap of two sets is surely too small."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    n = min(len(a), len(b))
    a, b = a.reshape(-1, n).sum(axis=0), b.reshape(-1, n).sum(axis=0)  # finer lanes fold onto coarser ones
    most = int(np.minimum(a, b).sum())
    return den * most >= num * (int(a.sum()) + int(b.sum()) - most)


def order_keys(tokens: np.ndarray, seed: int, hot: np.ndarray, hot_rank: np.ndarray) -> np.ndarray:
    """Places in a global order: the frequent behind, by frequency; else by a seeded hash."""
    keys = tb.mix(tokens ^ np.uint64(seed)) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        known = hot[at] == tokens
        keys[known] = HOT_BIT | hot_rank[at[known]]
    return keys


def _summaries(k: int):
    """Per row its set's size and hash; per slice the tokens found in several sets."""
    names = ["kind", "doc_id", "tkey", "n", "sig", "lanes", "token", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in tb.pieces(batches, "text"):
            w = tb.words(*tb.text_buffer(tb.column(part, "text")))
            ns, sigs, marks, fresh = [], [], [], []
            for s in tb.shingle_sets(w, k):
                sig = _sig(s) if len(s) else 0
                ns.append(len(s))
                sigs.append(sig)
                marks.append(None)
                if len(s) and sig not in seen:
                    seen.add(sig)
                    fresh.append(s)
                    marks[-1] = lanes(s)
            m = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), tb.column(part, "doc_id"), tb.column(part, "tkey"),
                 pa.array(ns, pa.int32()), pa.array(sigs, pa.int64()), pa.array(marks, pa.binary()),
                 pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
            if fresh:
                toks = np.sort(np.concatenate(fresh))
                at = np.flatnonzero(np.concatenate(([True], toks[1:] != toks[:-1])))
                df = np.diff(np.append(at, len(toks)))
                many = df >= 3
                if many.any():
                    toks, df = toks[at[many]], df[many]
                    none = pa.nulls(len(toks), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ones(len(toks), np.int32)), none, none, pa.nulls(len(toks), pa.int32()), none,
                         pa.nulls(len(toks), pa.binary()), pa.array(tb.signed(toks)), pa.array(df.astype(np.int64))], names)
    return run


def _frequent(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HOT_TOKENS tokens, those of the highest counts: sorted tokens, their ranks."""
    counts = tokens.groupBy("token").agg(F.sum("df").alias("df"))
    by_size = sorted(((r["p"], r["count"]) for r in counts.groupBy(F.floor(F.log2("df")).alias("p")).count().collect()), reverse=True)
    least, total = None, 0
    for p, count in by_size:  # at most 64 rows
        total += count
        if total > HOT_TOKENS:
            break
        least = 1 << int(p)
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    rows = counts.where(F.col("df") >= least).toPandas()
    toks = rows["token"].to_numpy(np.int64).view(np.uint64)
    rank = np.empty(len(toks), np.uint64)
    rank[np.lexsort((toks, rows["df"].to_numpy()))] = np.arange(len(toks), dtype=np.uint64)
    by = np.argsort(toks)
    return toks[by], rank[by]


def _prefixes(k: int, num: int, den: int, shipped):
    """(hot, token, sig, n, rare) for the prefix tokens of each class met in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shipped.value
        seen: set[int] = set()
        for part in tb.pieces(batches, "text"):
            w = tb.words(*tb.text_buffer(tb.column(part, "text")))
            sets, sigs = [], []
            for s in tb.shingle_sets(w, k):
                n = len(s)
                # a set that only an equal one can match needs no prefix
                if n == 0 or n * den // num == n and needed(n, num, den) == n:
                    continue
                sig = _sig(s)
                if sig not in seen:
                    seen.add(sig)
                    sets.append(s)
                    sigs.append(sig)
            if not sets:
                continue
            keys = order_keys(np.concatenate(sets), SEEDS[0], hot, rank)
            tok, sig_col, n_col, hot_col, rare, at = [], [], [], [], [], 0
            for s, sig in zip(sets, sigs, strict=True):
                n = len(s)
                own = keys[at:at + n]
                at += n
                p = prefix_length(n, num, den)
                first = np.argpartition(own, p - 1)[:p] if p < n else np.arange(n)
                tok.append(s[first])
                hot_col.append(own[first] >= HOT_BIT)
                sig_col.append(np.full(len(first), sig, np.int64))
                n_col.append(np.full(len(first), n, np.int32))
                rare.append(np.full(len(first), (own < HOT_BIT).mean(), np.float32))
            tok, hot_col, sig_col = tb.signed(np.concatenate(tok)), np.concatenate(hot_col), np.concatenate(sig_col)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hot_col), pa.array(tok), pa.array(sig_col),
                 pa.array(np.concatenate(n_col)), pa.array(np.concatenate(rare))], ["hot", "token", "sig", "n", "rare"])
    return run


_BUCKET_NAMES = ["kind", "token", "sig", "n", "rare", "hub", "hub_n"]
_BUCKET_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float32(), pa.int64(), pa.int32())


def unmet(held: list[list], num: int, den: int) -> Iterator[list]:
    """Of a bucket's classes [sig, n, rare, met], those whose length range holds more than the ``met`` classes
    they have been compared with (themselves included)."""
    ns = sorted(c[1] for c in held or [])
    for c in held or []:
        if bisect_right(ns, c[1] * den // num) - bisect_left(ns, needed(c[1], num, den)) > c[3]:
            yield c


def _buckets(num: int, den: int, most: int = HELD):
    """Rows come sorted by (token, rare, n, sig). Each class of a token is compared with the first class of its
    length range, its hub (kind 1), and goes out (kind 0) if it may link with others of the bucket. Hubs are of
    different length ranges, so they are few; a bucket of over ``most`` classes is not held but goes out whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, last, held, hubs = None, None, [], []
        out: list[tuple] = []

        def leave():
            out.extend((0, token, s, n, rare, None, None) for s, n, rare, _ in unmet(held, num, den))

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _BUCKET_KINDS, strict=True)], _BUCKET_NAMES)

        for batch in batches:
            hot, tok, sig, n, rare = (tb.column(batch, c).to_numpy(zero_copy_only=False) for c in ("hot", "token", "sig", "n", "rare"))
            rows = np.flatnonzero(hot)
            same = np.zeros(len(tok), bool)
            same[1:] = tok[1:] == tok[:-1]
            if len(tok):
                same[0] = token is not None and token == tok[0]
            near = same.copy()
            near[:-1] |= same[1:]
            near[-1:] = True  # the next batch may go on with it
            near &= ~hot
            for i in np.flatnonzero(near).tolist():
                t, s, m, r = int(tok[i]), int(sig[i]), int(n[i]), float(rare[i])
                if t != token:
                    leave()
                    token, last, held, hubs = t, None, [], []
                if last == s:
                    continue
                last, one = s, [s, m, r, 1]
                for hub in hubs:
                    if min(hub[1], m) * den >= max(hub[1], m) * num:
                        out.append((1, None, s, m, r, hub[0], hub[1]))
                        hub[3] += 1
                        one[3] = 2
                        break
                else:
                    hubs.append(one)
                if held is None:
                    out.append((0, t, s, m, r, None, None))
                    continue
                held.append(one)
                if len(held) > most:
                    out.extend((0, t, *c[:3], None, None) for c in held)
                    held = None
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), 2, np.int32)), pa.array(tok[rows]), pa.array(sig[rows]), pa.array(n[rows]), pa.array(rare[rows]),
                     pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32())], _BUCKET_NAMES)
            if out:
                yield table()
                out.clear()
        leave()
        if out:
            yield table()
    return run


BLOCK = 2048


def _folded(x: np.ndarray, n: int) -> np.ndarray:
    return x.reshape(len(x), -1, n).sum(axis=1, dtype=np.uint16)


def unsettled(sig, n, comp, top, side, marks, cell, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of a unit's classes that are in different components and may link. Classes of the
    bucket's largest component are compared with others only, so the loop runs over those."""
    width = np.array([len(m) for m in marks])
    by_width = {}
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        own = np.frombuffer(b"".join([marks[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), w).astype(np.uint16)
        by_width[w] = (rows, own, _folded(own, w // 2))
    full = np.flatnonzero(width == 0)  # no lanes: nothing to bound by
    out = []
    for x in np.flatnonzero(comp != top).tolist():
        other = (cell[0] + cell[1]) - side[x]  # the block that x meets in this unit

        def fine(rows, x=x, other=other):
            return ((side[rows] == other) & (comp[rows] != comp[x]) & ((comp[rows] == top[rows]) | (sig[rows] > sig[x]))
                    & (np.minimum(n[rows], n[x]) * den >= np.maximum(n[rows], n[x]) * num))

        w = int(width[x])
        if not w:
            out += [(int(sig[x]), int(sig[y])) for y in np.flatnonzero(fine(np.arange(len(sig)))).tolist()]
            continue
        mine = np.frombuffer(marks[x], np.uint8).astype(np.uint16)[None, :]
        for v, one, use in ((w, mine, 1), (2 * w, mine, 2), (w // 2, _folded(mine, max(1, w // 2)), 1)):
            if v not in by_width:
                continue
            rows = by_width[v][0]
            good = np.flatnonzero(fine(rows))
            if len(good):
                most = np.minimum(by_width[v][use][good], one).sum(axis=1, dtype=np.int64)
                rows = rows[good]
                rows = rows[den * most >= num * (n[rows] + n[x] - most)]
                out += [(int(sig[x]), int(sig[y])) for y in rows.tolist()]
        out += [(int(sig[x]), int(sig[y])) for y in full[fine(full)].tolist()]
    return out


def _units(num: int, den: int):
    """Rows sorted by (anchor, i, j): the unsettled pairs of each unit."""
    def solve(cell, rows):
        sig, n, comp, top, side, marks = zip(*rows, strict=True)
        pairs = unsettled(np.array(sig), np.array(n, np.int64), np.array(comp), np.array(top), np.array(side), marks, cell, num, den)
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            cols = [tb.column(batch, c).to_pylist() for c in ("anchor", "i", "j", "sig", "n", "comp", "top", "side", "lanes")]
            for row in zip(*cols, strict=True):
                if row[:3] != unit:
                    if len(rows) > 1:
                        yield solve(unit[1:], rows)
                    unit, rows = row[:3], []
                rows.append(row[3:])
        if len(rows) > 1:
            yield solve(unit[1:], rows)
    return run


SLOTS = 1 << 22


def _wanted(sigs: DataFrame) -> np.ndarray:
    """A bitmap of the classes' hashes modulo SLOTS: whatever their number, at most SLOTS values are gathered."""
    slots = sigs.select(F.pmod("sig", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)
    bits = np.zeros(SLOTS >> 3, np.uint8)
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return bits


def _sets(k: int, shipped):
    """The sets of the classes in the bitmap, from the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        seen: set[int] = set()
        for part in tb.pieces(batches, "text"):
            w = tb.words(*tb.text_buffer(tb.column(part, "text")))
            sigs, toks = [], []
            for s in tb.shingle_sets(w, k):
                sig = _sig(s)
                slot = sig % SLOTS
                if sig not in seen and bits[slot >> 3] >> (slot & 7) & 1:
                    seen.add(sig)
                    sigs.append(sig)
                    toks.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(toks, pa.binary())], ["sig", "toks"])
    return run


def _bounded(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([may_link(x.as_py(), y.as_py(), num, den) for x, y in zip(tb.column(batch, "la"), tb.column(batch, "lb"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([tb.column(batch, "a").filter(good), tb.column(batch, "b").filter(good)], ["a", "b"])
    return run


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int, hot: np.ndarray, rank: np.ndarray) -> bool:
    """Prefix filters under the second and third order, then the exact sizes."""
    if len(x) > len(y):
        x, y = y, x
    if den * len(x) < num * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = x[y[at] == x]
    if not len(common):
        return False
    for seed in SEEDS[1:]:
        place = order_keys(common, seed, hot, rank).min()
        for s in (x, y):  # the first shared token must stand within both prefixes
            if int((order_keys(s, seed, hot, rank) < place).sum()) >= prefix_length(len(s), num, den):
                return False
    return den * len(common) >= num * (len(x) + len(y) - len(common))


def _verified(num: int, den: int, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shipped.value
        for batch in batches:
            a, b = tb.column(batch, "a"), tb.column(batch, "b")
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den, hot, rank)
                    for x, y in zip(tb.column(batch, "ta"), tb.column(batch, "tb"), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(keep, pa.bool_())], ["a", "b", "linked"])
    return run


def _compare(pairs: DataFrame, marks: DataFrame, texts: DataFrame, k: int, num: int, den: int, shipped) -> DataFrame:
    """The pairs that link: lanes first, then the sets of those left."""
    sc = pairs.sparkSession.sparkContext
    left = marks.select(F.col("sig").alias("a"), F.col("lanes").alias("la"))
    right = marks.select(F.col("sig").alias("b"), F.col("lanes").alias("lb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb")
    possible = written(rows.mapInArrow(_bounded(num, den), "a long, b long"), "shingle-possible")
    bits = sc.broadcast(_wanted(possible.select(F.col("a").alias("sig")).union(possible.select("b"))))
    sets = written(texts.mapInArrow(_sets(k, bits), "sig long, toks binary"), "shingle-sets").dropDuplicates(["sig"])
    one = sets.select(F.col("sig").alias("a"), F.col("toks").alias("ta"))
    two = sets.select(F.col("sig").alias("b"), F.col("toks").alias("tb"))
    full = possible.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return written(full.mapInArrow(_verified(num, den, shipped), "a long, b long, linked boolean").where("linked").select("a", "b"), "shingle-links")


def near_duplicate_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents whose k-word shingle sets have Jaccard similarity >= num/den.

    Reads doc_id and text. Returns one row per input row: doc_id, tkey (hash of
    the text), n_shingles, component (a number of its group; null for an empty set),
    component_id (smallest doc_id reachable by links, itself included)."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    keyed = own.withColumn("tkey", text_key())
    found = written(keyed.mapInArrow(_summaries(k), "kind int, doc_id long, tkey long, n int, sig long, lanes binary, token long, df long"),
                    "shingle-summary", by="kind")
    rows = found.where("kind = 0").select("doc_id", "tkey", "n", "sig", "lanes")
    shipped = spark.sparkContext.broadcast(_frequent(found.where("kind = 1")))
    posted = (own.select("text").where(F.col("text").isNotNull())
              .mapInArrow(_prefixes(k, num, den, shipped), "hot boolean, token long, sig long, n int, rare float"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = written(posted.repartition(parts, F.when(F.col("hot"), F.col("sig")).otherwise(F.col("token"))).sortWithinPartitions("token", "rare", "n", "sig")
                      .mapInArrow(_buckets(num, den), "kind int, token long, sig long, n int, rare float, hub long, hub_n int"),
                      "shingle-buckets", by="kind")
    # a frequent token's length ranges: powers of den/num
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))
    hot_rows = buckets.where("kind = 2").select("token", "sig", "n", "rare").distinct().withColumn("band", band)
    hubs = hot_rows.groupBy("token", "band").agg(F.min(F.struct("rare", "n", "sig")).alias("h"))
    hot_pairs = (hot_rows.join(hubs, ["token", "band"]).where(F.col("sig") != F.col("h.sig"))
                 .select("sig", "n", F.col("h.sig").alias("hub"), F.col("h.n").alias("hub_n")))
    pairs = written(buckets.where("kind = 1").select("sig", "n", "hub", "hub_n").unionByName(hot_pairs)
                    .where((F.least("n", "hub_n") * den) >= (F.greatest("n", "hub_n") * num))
                    .select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b")).distinct(), "shingle-pairs")
    members = buckets.where("kind <> 1").select("token", "sig", "n").distinct()

    marks = rows.where("lanes IS NOT NULL").select("sig", "lanes").dropDuplicates(["sig"])
    texts = own.select("text").where(F.col("text").isNotNull())
    links = _compare(pairs, marks, texts, k, num, den, shipped)
    first = connected(links)

    # what a star cannot settle: classes of one bucket in different components
    at = members.join(first.withColumnRenamed("node", "sig"), "sig", "left").select(
        "token", "sig", "n", F.coalesce("component", "sig").alias("comp"))
    # buckets of one least class are taken together: those of a shared passage hold much the same classes
    anchors = (at.groupBy("token").agg(F.min("sig").alias("anchor"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
               .where("lo <> hi").select("token", "anchor"))
    mixed = at.join(anchors, "token").select("anchor", "sig", "n", "comp").distinct()
    sizes = mixed.groupBy("anchor", "comp").agg(F.count(F.lit(1)).alias("m"))
    tops = sizes.groupBy("anchor").agg(F.max(F.struct("m", "comp")).alias("t"), F.sum("m").alias("m")).select(
        "anchor", F.col("t.comp").alias("top"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    units = (mixed.join(tops, "anchor").withColumn("side", F.pmod(F.xxhash64("sig", F.lit("side")), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("anchor", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "sig", "n", "comp", "top", "side")
             .join(marks, "sig"))
    rest = written(units.repartition(parts, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "sig")
                   .mapInArrow(_units(num, den), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"), "shingle-rest")
    more = _compare(rest, marks, texts, k, num, den, shipped)
    classes = connected(first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                        .unionByName(more))

    own_min = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least_id"))
    by_class = own_min.join(classes.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "component", F.coalesce("component", "sig"))
    roots = by_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = by_class.join(roots, "component").select("sig", "component", "component_id")
    return (rows.withColumn("sig", F.when(F.col("n") > 0, F.col("sig"))).join(named, "sig", "left")
            .select("doc_id", "tkey", F.col("n").cast("long").alias("n_shingles"), "component",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs with one document of each group of near duplicates: the one of
    the least doc_id (then text hash). Documents without words are in no group and stay."""
    groups = near_duplicate_classes(docs, k, num, den).where(F.col("component").isNotNull())
    least = F.lit(-(1 << 63))
    chosen = (groups.select("component", F.coalesce("doc_id", least).alias("_id"), F.col("tkey").alias("_tkey"))
              .groupBy("component").agg(F.min(F.struct("_id", "_tkey")).alias("r")).select("r._id", "r._tkey"))
    # a row travels whole as one struct, so its columns may have any names
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.select(F.coalesce("doc_id", least).alias("_id"), text_key().alias("_tkey"), worded.alias("worded"), whole_row(docs))
    kept = keyed.where("worded").join(chosen, ["_id", "_tkey"], "left_semi").dropDuplicates(["_id", "_tkey"])
    return kept.unionByName(keyed.where("not worded")).select("row.*")


def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return near_duplicate_classes(docs, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


#: All pairs by shared shingles, then reachability.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p + 1 : p + 4], ' ')) AS k
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
