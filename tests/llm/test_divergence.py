"""Operator 13 against brute force, also where several terms share a digest."""

import random
import re
from collections import Counter, defaultdict

import pytest

from mdloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLS = ("lang", "source", "part", "item", "value", "rank")


def brute(docs, least=30, most=50):
    rows = [(lang or "", source or "", Counter(TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))) for text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        df, total = Counter(), Counter()
        of = defaultdict(Counter)
        for la, source, c in rows:
            if la == lang:
                df.update(c.keys())
                total.update(c)
                of[source].update(c)
        kept = [t for t in df if df[t] >= least]
        v = len(kept)

        def p(c, t):
            n = sum(c[x] for x in kept)
            return 1 + 10**9 * (c[t] + 5) // (n + 5 * v)

        ps = {s: {t: p(c, t) for t in kept} for s, c in of.items()}
        q = {t: p(total, t) for t in kept}
        for s in of:
            pair = [(other, sum(abs(ps[s][t] - ps[other][t]) for t in kept)) for other in of if other != s]
            term = [(t, ps[s][t] - q[t]) for t in kept if of[s][t] > 0 and ps[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:limit])]
    return sorted(out)


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    vocab = ["the", "The", "été", "a", "B", "zoo", "\U0001F600x", "long" * 30] + [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    weights = [1 / (i + 1) ** 0.7 for i in range(len(vocab))]
    docs = []
    for i in range(n):
        words = rng.choices(vocab, weights, k=rng.choice([0, 1, 20, 60]))
        text = "".join(w + rng.choice([" ", "1", "-", "\n"]) for w in words)
        docs.append((text, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "", None, "Ünter"])))
    return docs + [(None, "en", "empty"), ("", "none", "x"), ("solo word", "few", "y"), ("again", "few", "z"), ("", None, None)] + docs[:40]


def got(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


@pytest.mark.parametrize("bits", [64, 5])
def test_equals_brute_force(spark, bits):
    docs = corpus()
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(4)
    assert got(divergence.divergence(df, 30, 12, bits)) == brute(docs, 30, 12)


def test_small_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    docs = corpus(2)
    data, offs = divergence.tb.text_buffer(divergence.pa.array([t for t, _, _ in docs]))
    batch = divergence.pa.RecordBatch.from_arrays([divergence.pa.array([x[i] or "" for x in docs]) for i in (0, 1, 2)], ["text", "lang", "source"])
    rows = divergence.pa.Table.from_batches([*divergence._counted(64)(iter([batch.slice(0, 200), batch.slice(200)]))]).to_pylist()
    n = Counter()
    for r in rows:
        if r["kind"] == 0:
            n[r["lang"], r["source"], r["digest"]] += r["n"]
    term = {r["digest"]: r["least"] for r in rows if r["kind"] == 1}
    want = Counter()
    for text, lang, source in docs:
        for t in TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            want[lang or "", source or "", t] += 1
    assert Counter({(a, b, term[d]): c for (a, b, d), c in n.items()}) == want
    assert all(r["most"] is None for r in rows if r["kind"] == 1)
    assert {(r["lang"], r["source"]) for r in rows if r["kind"] == 2} == {(x[1] or "", x[2] or "") for x in docs}


def test_batches_hand_on_a_row_per_group_and_term(monkeypatch):
    docs = corpus(4)
    batch = divergence.pa.RecordBatch.from_arrays([divergence.pa.array([x[i] or "" for x in docs]) for i in (0, 1, 2)], ["text", "lang", "source"])
    added, real = [], divergence._Counts.add

    def add(self, group, digest, n, docs):
        added.append((len(group), int(n.sum()), int(docs.sum())))
        return real(self, group, digest, n, docs)
    monkeypatch.setattr(divergence._Counts, "add", add)
    list(divergence._counted(64)(iter([batch])))
    found = [((lang or "", source or ""), TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for text, lang, source in docs]
    assert added == [(len({(g, t) for g, terms in found for t in terms}), sum(len(terms) for _, terms in found), sum(len(set(terms)) for _, terms in found))]


def test_distances_in_blocks(spark, monkeypatch):
    docs = corpus(3)
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    real = divergence._distances

    def small(rows):
        divergence.CELLS, divergence.SOURCES = 17, 2
        return real(rows)
    monkeypatch.setattr(divergence, "_distances", small)
    assert got(divergence.divergence(df)) == brute(docs)


def test_odd_input(spark):
    docs = corpus(1, 80)
    df = spark.createDataFrame([(*d, 1, "k", None) for d in docs], "text string, lang string, source string, kind int, digest string, doc_id long")
    assert got(divergence.divergence(df, 20)) == brute(docs, 20)
    assert divergence.divergence(df.where("false")).count() == 0
    assert got(divergence.divergence(df, 10_000)) == brute(docs, 10_000)


def test_probability_is_exact(spark):
    cases = [(c, n, v) for c in (0, 1, 7, 10**9, 10**15) for n in (c, c + 1, c * 3 + 17, 9 * 10**15 - 10) for v in (1, 2, 10**7) if n >= c]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.probability(*[divergence.F.col(x) for x in "cnv"]).alias("p"))
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v), r
