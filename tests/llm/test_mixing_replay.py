"""The mix against a replay in Python: quotients one after the other, draws one after the other."""

import heapq
from collections import Counter

from pyspark.sql import functions as F

from mdloom.llm import mixing


def table(spark):
    data, at = [], 0
    for source, n in (("a", 300), ("b", 40), (None, 90), ("d", 7), ("empty", 2)):
        for i in range(n):
            data.append((at, "" if source == "empty" else " ".join(f"v{at}x{j}" for j in range((i * 37) % 150)), source))
            at += 1
    data += [(None, "same words here", "a")] * 20 + [(at, None, "b"), (at + 1, " ".join(f"long{j}" for j in range(9000)), "d")]
    return spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)


def replay(spark, docs, blocks, shards):
    """(doc_id, source, size, words by shard) of each document, as a sorted list."""
    rows = (docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "text")
            .withColumn("mark", F.xxhash64("doc_id", "tkey", F.lit(mixing.SEED))).collect())
    size = {id(r): len((r.text or "").split()) for r in rows}
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[id(r)] for r in rows if r.source == s) for s in names}
    target, free, left = {}, set(names), float(sum(own.values()))
    while True:  # the excess of those above their cap is reshared until none is
        weights = {s: names.index(s) % 3 + 1 for s in free}
        over = {s for s in free if left * weights[s] / sum(weights.values()) >= 3 * own[s]}
        if not over:
            target |= {s: left * w / sum(weights.values()) for s, w in weights.items()}
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= target[s]
        free -= over
    total = sum(target.values())
    length = max(1, -(-total // max(blocks, 16 * len(names))))
    n = round(total / length)
    heap = [(-target[s] / total, i, 0, s) for i, s in enumerate(names) if target[s] > 0]
    heapq.heapify(heap)
    shard_of = {s: [] for s in names}
    per_shard = -(-n // shards)
    for seat in range(n):
        _, i, k, s = heapq.heappop(heap)
        shard_of[s].append(seat // per_shard)
        heapq.heappush(heap, (-target[s] / total / (2 * k + 3), i, k + 1, s))
    out = []
    for i, s in enumerate(names):
        count = max(1, -(-own[s] // int(length)))
        step = (mixing.PRIMES[0] if count % mixing.PRIMES[0] else mixing.PRIMES[1]) % count
        shift = spark.range(1).select(F.pmod(F.xxhash64(F.lit(i), F.lit(mixing.SEED)), F.lit(count))).first()[0]
        block_at = {(b * step + shift) % count: b for b in range(count)}
        draws = {}  # block: the shards that draw it
        for t, shard in enumerate(shard_of[s][:3 * count]):
            draws.setdefault(block_at[t % count], []).append(shard)
        upto = 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.mark, r.doc_id is not None, r.doc_id or 0, r.tkey)):
            words = Counter()
            for place in range(upto, upto + size[id(r)]):
                for shard in draws.get(place // int(length), []):
                    words[shard] += 1
            upto += size[id(r)]
            out.append((str(r.doc_id), str(s), size[id(r)], sum(words.values()), sorted(words.items())))
    return sorted(out)


def test_taken_and_shards_equal_a_replay(spark):
    docs = table(spark)
    seen = []
    for blocks, shards in ((64, 5), (500, 7)):
        found, quotas = mixing.mixed(mixing.sizes_of(docs), blocks=blocks, shards=shards)
        got = []
        for r in found.collect():
            by = Counter()
            for d in r.draws or []:
                by[d.shard] += d.words
            got.append((str(r.doc_id), str(r.source), r["size"], r.taken, sorted((k, v) for k, v in by.items() if v)))
        assert sorted(got) == replay(spark, docs, blocks, shards)
        by_doc = Counter()
        for r in mixing.shard_words(found).collect():
            by_doc[r.doc_id, r.source] += r.words
        assert by_doc == Counter({k: v for k, v in _taken(found).items() if v})
        assert quotas.agg(F.countDistinct("shard")).first()[0] == shards
        seen.append(got)
    assert seen[0] != seen[1]


def _taken(found):
    out = Counter()
    for r in found.collect():
        out[r.doc_id, r.source] += r.taken
    return out
