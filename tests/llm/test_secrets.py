"""Operator 3: base spans and masking against brute force, models on held-out strings, very long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mdloom.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
WORDS = ("get set user account name value index count list table array string number parse build create delete update remove insert find search sort "
         "filter map reduce join merge split request response handler service client server module package class method function config option "
         "setting default enable disable start stop open close read write load save input output buffer stream event message queue worker task").split()
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def base(text):
    return sorted(((m.start(), k, name, m.end()) for k, (name, p, keep) in enumerate(BASE) for m in p.finditer(text) if keep(m)))


def strings(rng, chars, n=50, size=(24, 40)):
    return ["".join(rng.choices(chars, k=rng.randint(*size))) for _ in range(n)]


def identifiers(rng, n):
    out = []
    for _ in range(n):
        w = rng.choices(WORDS, k=rng.randint(4, 6))
        out.append(rng.choice([lambda: "_".join(w), lambda: "_".join(w).upper(), lambda: "-".join(w), lambda: ".".join(w), lambda: "/".join(w),
                               lambda: "".join(x.title() for x in w), lambda: w[0] + "".join(x.title() for x in w[1:]), lambda: "_".join(w) + str(rng.randint(1, 99)),
                               lambda: "".join(w), lambda: "www." + ".".join(w) + ".com/" + w[0]])())
    return [x for x in out if len(x) >= 16]


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(4)
    alnum = LOWER + UPPER + DIGITS
    lines = [f"api_key = \"{x}\" and {y}" for x, y in zip(strings(rng, alnum, 400) + strings(rng, "0123456789abcdef", 200), identifiers(rng, 620), strict=False)]
    return [(i, x, "en", "s", len(x)) for i, x in enumerate(lines)]


def test_models_tell_random_strings_from_identifiers(spark, labelled):
    rng = random.Random(5)
    kinds = {"lower": strings(rng, LOWER), "upper": strings(rng, UPPER), "hex": strings(rng, "0123456789ABCDEF"), "mixed": strings(rng, LOWER + UPPER + DIGITS),
             "base64": [x + "==" for x in strings(rng, LOWER + UPPER + DIGITS + "+/")],
             "dotted": [".".join(strings(rng, LOWER + UPPER + DIGITS, 3, (14, 14))) for _ in range(50)], "names": identifiers(rng, 600)}
    rows, want = list(labelled), {}
    for kind, values in kinds.items():
        for v in values:
            want[1000 + len(rows)] = (kind, v)
            rows.append((1000 + len(rows), f"see {v} there", "en", "s", 0))
    found = {r.doc_id: r._spans for r in secrets.with_spans(spark.createDataFrame(rows, SCHEMA)).where("doc_id >= 1000").collect()}
    share = {k: sum(bool(found[i]) for i, (kind, _) in want.items() if kind == k) / len(v) for k, v in kinds.items()}
    assert share["names"] <= 0.01 and all(share[k] >= 0.9 for k in kinds if k != "names"), share
    # a found run is covered from its first to its last character
    for i, (_, v) in want.items():
        covered = {p for s in found[i] for p in range(s.start, s.stop)}
        assert not covered or covered == set(range(4, 4 + len(v)))


def corpus(rng, n):
    parts = ["token=", "password: ", "Secret = '", "api_key\"=\"", "AKIA", "0123456789abcdef" * 2, "ABCDEFGHIJKLMNOPQRST", "deadbeef", " ", "\n", "é\U0001F600", "word ", "x" * 5, "=", "hunter22", "'", "/"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)]


def test_base_spans_and_masking_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", *corpus(rng, 1000), " token=abcdef AKIA" + "Z" * 20 + " some text é" * 100_000, "\n".join(corpus(rng, 20_000))]
    assert max(len(t or "") for t in texts) > 1_000_000
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA + ", _base int, _runs int, _text int, spans int").repartition(4)
    got = {r.doc_id: r for r in secrets.with_spans(df).collect()}
    clean = {r.doc_id: r for r in secrets.masked(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        r = got[i]
        fixed = base(t)
        assert [(s.start, s.kind, s.stop) for s in r["__base"]] == [(a, name, e) for a, _, name, e in fixed]
        assert (r._base, r._runs, r._text, r.spans) == (1, 2, 3, 4) and tuple(clean[i][5:]) == (1, 2, 3, 4)
        out, at = [], 0
        for s in sorted(r._spans, key=lambda s: (s.start, s.stop)):
            if s.start >= at:
                out += [t[at:s.start], "[SECRET]"]
            at = max(at, s.stop)
        assert (clean[i].text or "") == "".join(out) + t[at:]
        covered = {p for a, _, _, e in fixed for p in range(a, e)}
        assert not covered & {p for s in r._spans if s.kind == "markov" for p in range(s.start, s.stop)}


def test_time_grows_with_the_text(spark, labelled):
    rng = random.Random(6)

    def seconds(n):
        text = " ".join(strings(rng, LOWER + UPPER + DIGITS, n, (32, 36)))
        df = spark.createDataFrame([*labelled, (9999, text, "en", "s", 0)], SCHEMA)
        start = time.perf_counter()
        row = secrets.masked(df).where("doc_id = 9999").first()
        assert row.text.count("[SECRET]") > 0.9 * n
        return time.perf_counter() - start
    seconds(500)
    few, many = seconds(4000), seconds(32_000)  # 144,000 and 1.1 million characters
    assert many < 10 * few + 5
