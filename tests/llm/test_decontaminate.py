"""Operator 11 against brute force: word windows of a benchmark in texts."""

import random
import re

import pytest

from mdloom.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute(docs, bench, window=10):
    pats = {}
    for item, text in bench:
        w = WORD.findall(lower(text))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            pats.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        found = list(WORD.finditer(lower(text)))
        w = [m.group() for m in found]
        hit, ids = set(), set()
        for k in {len(p) for p in pats}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in pats:
                    hit.update(range(i, i + k))
                    ids |= pats[tuple(w[i:i + k])]
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1][1] = found[i].end()
            else:
                spans.append([found[i].start(), found[i].end()])
        out.append((doc, len(w), len(hit), sorted(ids), spans))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.found.n_words, r.found.n_hit, list(r.found.item_ids), [[s.start, s.stop] for s in r.found.spans])
                   for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "a", "un", "Élan", "x9", "B", "été", "\U0001F600", "long" * 20]

    def text(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-", "…x ", "\t"]) for _ in range(n))

    bench = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 60]))) for i in range(25)] + [(3, text(20)), (None, text(15)), (77, None), (78, "--- !"), (80, text(14))]
    bench.append((81, bench[-1][1]))  # a copy under another id
    docs = [(i, text(rng.choice([0, 2, 12, 400, 3000]))) for i in range(40)] + [(None, "x"), (500, None), (501, "")]
    for i in range(60):
        body = bench[rng.randrange(len(bench))][1] or ""
        docs.append((600 + i, text(rng.randrange(300)) + " " + body.upper() + " " + text(5)))
    return [*docs, docs[45]], bench


@pytest.mark.parametrize("block", [1 << 23, 300])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)  # the small one makes several passes
    docs, bench = corpus(block)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = found(decontaminate.contaminated(df, items))
    assert got == brute(docs, bench)
    assert sum(r[2] > 0 for r in got) > 40


def test_hashes_alone_decide_nothing(spark, monkeypatch):
    """With all window hashes equal only the comparison of bytes is left."""
    docs, bench = corpus(5)
    real = decontaminate.tb.mix
    monkeypatch.setattr(decontaminate.tb, "mix", lambda x: real(x) & decontaminate.U64(0xF000000000000000))
    import pyarrow as pa
    rows = pa.table({"number": list(range(len(bench))), "text": pa.array([t or "" for _, t in bench], pa.large_string())})
    tables = decontaminate.patterns(rows)
    names = {i: "" if x is None else str(x) for i, (x, _) in enumerate(bench)}
    for doc, n_words, n_hit, ids, _ in brute(docs[:70], bench):
        raw = next(t for d, t in docs if d == doc) or ""
        data, offs = decontaminate.tb.text_buffer(pa.array([raw]))
        text = decontaminate.Compact(data, offs)
        hit, got = set(), set()
        for t in tables:
            n = max(0, len(text.hashes) - t.length + 1)
            place, pattern = t.confirmed(text, *t.search(text, decontaminate.np.arange(0, n, 256), decontaminate.np.minimum(decontaminate.np.arange(0, n, 256) + 256, n)))
            for p, i in zip(place.tolist(), pattern.tolist(), strict=True):
                hit.update(range(p, p + t.length))
                got.add(names[int(t.items[i])])
        assert (len(text.hashes), len(hit), sorted(got)) == (n_words, n_hit, ids)


def test_odd_input(spark):
    docs, bench = corpus(1)
    df = spark.createDataFrame([(*d, 1, "k", [1]) for d in docs], "doc_id long, text string, _n int, _items string, found array<int>")
    items = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, number int")
    got = decontaminate.contaminated(df.drop("found"), items)
    assert got.columns == ["doc_id", "text", "_n", "_items", "found"] and found(got) == brute(docs, bench)
    assert sorted((r.doc_id, r.text) for r in got.where("doc_id is not null").collect() if r.text is None) == [(500, None)]
    no_docs, no_items = df.where("false").drop("found"), items.where("false")
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert all(r.found.n_hit == 0 and not r.found.item_ids for r in decontaminate.contaminated(df.drop("found"), no_items).collect())


def test_long_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    bench = [(i, " ".join(words[a:a + 40])) for i, a in enumerate(range(1000, 190_000, 9000))]
    docs = [(1, " ".join(words)), (2, " ".join(reversed(words)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(decontaminate.contaminated(df, spark.createDataFrame(bench, "item_id long, text string")))
    assert got == brute(docs, bench) and got[0][2] == 40 * len(bench)
