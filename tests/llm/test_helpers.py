"""The numpy helpers against plain Python."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mdloom.llm import embedding_dedup, fingerprints, hmm_lm, ngram_join, packing, textbatch, token_files, tokenwords

ODD = ["", None, "a\nB c", "it's 12ab3 <|endoftext|>x <|ENDOFTEXT|> <|startoftext|>", "É́ ÉTÉ naïve ×÷ İx ǅz ŉ ſß", "a\x1cb \x85 z",
       "İstanbul ΣΑΣ", "don't we'LL I'M", "x" * 5000, "!!!??? -- 1234567890 ½", "日本語 テスト", "\x00a \x7f b", "  ", "́abc x ́", "the The THE the"]


def test_words_and_shingles():
    data, offs = textbatch.text_buffer(pa.array(ODD))
    w = textbatch.words(data, offs)
    plain = [(x or "").encode().lower().split() for x in ODD]
    assert w.counts.tolist() == [len(x) for x in plain]
    seen = {}
    for word, h in zip(itertools.chain(*plain), w.hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    for words, s in zip(plain, textbatch.shingle_sets(w, 2), strict=True):
        assert len(s) == (len({tuple(words[i:i + 2]) for i in range(len(words) - 1)}) if len(words) > 1 else len(words[:1]))


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenwords.tokenizer_path("word_bpe_49k.json")
    enc, tok = tokenwords.WordEncoder(path), Tokenizer.from_file(path)
    latin = " ".join(chr(c) + "a " + chr(c) for c in range(0xC0, 0x280))
    for _ in range(2):  # the second time from the worker's table
        ids, counts = enc.encode(*textbatch.text_buffer(pa.array([*ODD, latin])))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [tok.encode(x or "", add_special_tokens=False).ids for x in [*ODD, latin]]


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, tight = token_files.code_lengths(counts, 18), token_files.code_lengths(counts, 4)
    assert math.isclose((0.5 ** free.astype(float)).sum(), 1) and tight.max() == 4 and (0.5 ** tight.astype(float)).sum() <= 1
    import heapq
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((counts * free).sum()) == cost


@pytest.mark.parametrize("kinds", [1, 2, 700])
def test_runs_round_trip(kinds):
    rng = np.random.default_rng(kinds)
    ids = rng.integers(0, kinds, 5000) * 7
    runs = np.array([1024, 1, 2000, 1975])
    used, counts = np.unique(ids, return_counts=True)
    book = token_files.Codebook(used, token_files.code_lengths(counts))
    payload, at = token_files.encode_runs(ids, runs, *book.for_writing())
    assert token_files.decode_runs(payload, runs, at * 8, *book.for_reading()).tolist() == ids.tolist()


def test_best_fit():
    sizes = [7, 6, 5, 4, 3, 3, 2]
    bins, places, room = packing.best_fit(sizes, 10)
    assert len(room) == 3 and sum(room) == 0
    for b in set(bins):
        own = sorted((p, s) for x, p, s in zip(bins, places, sizes, strict=True) if x == b)
        assert [p for p, _ in own] == [0, *itertools.accumulate(s for _, s in own[:-1])]


def test_fingerprints_insert_and_delete():
    a, b = fingerprints.paragraphs("one\ntwo\nthree"), fingerprints.paragraphs("three\none\ntwo")
    assert fingerprints.as_text(fingerprints.vector(a)) == fingerprints.as_text(fingerprints.vector(b))
    grown = fingerprints.inserted(fingerprints.vector(a), ["four"])
    assert fingerprints.as_text(grown) == fingerprints.as_text(fingerprints.vector([*b, "four"]))
    assert fingerprints.as_text(fingerprints.deleted(grown, ["four"])) == fingerprints.as_text(fingerprints.vector(a))
    assert fingerprints.likeness(fingerprints.vector(a), fingerprints.vector(b)) == 1.0
    many = [str(i) for i in range(40)]
    near = fingerprints.likeness(fingerprints.vector(many), fingerprints.vector([*many[:30], *"abcdefghij"]))
    assert 0.4 < near < 0.8 and fingerprints.likeness(fingerprints.vector(many), fingerprints.vector([f"x{i}" for i in range(40)])) < 0.2


@pytest.mark.parametrize("n", [1, 4, 1000, 20000])
def test_likeness_at_any_number_of_paragraphs(n):
    def vec(a, b):
        return fingerprints.vector([f"paragraph {i}" for i in range(a, b)])

    for seed in range(0, 12 * n, 3 * n):
        one, edit, other = vec(seed, seed + n), vec(seed + n // 4, seed + n + n // 4), vec(seed + 3 * 10**6, seed + 3 * 10**6 + n)
        assert fingerprints.likeness(one, one.copy()) == 1.0 and fingerprints.likeness(one, other) < 0.3
        assert n < 4 or abs(fingerprints.likeness(one, edit) - 0.6) < 0.15
    many = fingerprints.vector(["a line of its own"] * n + ["kept"] * n)
    assert abs(fingerprints.likeness(many, fingerprints.vector(["kept"] * n)) - 0.5) < 0.15
    assert fingerprints.as_text(fingerprints.deleted(fingerprints.inserted(one, ["x", "y"]), ["y", "x"])) == fingerprints.as_text(one)


def test_likeness_of_short_texts():
    text = " ".join(f"word{i}" for i in range(35))
    near = fingerprints.edited(text, "something else " * 20)
    assert 200 < len(text) < 257 and fingerprints.likeness(*(fingerprints.vector(fingerprints.paragraphs(t)) for t in (text, near))) > 0.25


def test_forward_recursion_sums_over_all_paths():
    rng = np.random.default_rng(3)
    s, m = hmm_lm.STATES, hmm_lm.SYMBOLS
    model = hmm_lm.Hmm(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(m), s))
    texts = [np.array([5, 9, 2047]), np.array([2047]), np.array([1, 2, 3, 4])]
    got = hmm_lm.log_likelihoods(model, texts)
    for x, ll in zip(texts, got, strict=True):
        total = 0.0
        for path in itertools.product(range(s), repeat=len(x)):
            p = model.start[path[0]] * model.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= model.move[path[t - 1], path[t]] * model.emit[x[t], path[t]]
            total += p
        assert math.isclose(ll, math.log(total), rel_tol=1e-9)


def test_baum_welch_does_not_lower_the_likelihood():
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 20, 60) + (30 if i % 2 else 0), hmm_lm.END) for i in range(30)]
    model, last = hmm_lm.Hmm.first(np.bincount(np.concatenate(texts), minlength=hmm_lm.SYMBOLS)), -np.inf
    for _ in range(4):
        now = hmm_lm.log_likelihoods(model, texts).sum()
        assert now > last - 1e-6 or math.isclose(now, last, rel_tol=0.02)
        last, model = now, hmm_lm.Hmm.from_counts(hmm_lm.expected_counts(model, texts))


def test_bounds_never_drop_a_link():
    rng = np.random.default_rng(5)
    none = np.empty(0, np.uint64)
    for n in (8, 60, 500):
        for share in (0.8, 0.85, 0.93, 1.0):
            common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            x, y = (np.unique(np.concatenate((common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)))) for _ in range(2))
            inter = len(np.intersect1d(x, y))
            true = 100 * inter >= 85 * (len(x) + len(y) - inter)
            assert ngram_join.similar(x, y, 85, 100, none, none) == true
            assert ngram_join.may_link(ngram_join.lanes(x), ngram_join.lanes(y), 85, 100) or not true


@pytest.mark.parametrize("most", [0, 3, 100])
def test_buckets_leave_no_pair_uncompared(most):
    rng = np.random.default_rng(5)
    n_of = rng.choice([3, 40, 41, 45, 50, 60, 70, 72, 400], 30)
    rows = []
    for token in range(60):
        for s in rng.choice(30, rng.integers(1, 9), replace=False).tolist():
            rows += [(token == 7, token, s, int(n_of[s]), s / 32)] * int(rng.integers(1, 3))
    rows.sort(key=lambda r: (r[1], r[4], r[3], r[2]))
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.float32())
    table = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["hot", "token", "sig", "n", "rare"])
    batches = [table.slice(i, 7) for i in range(0, table.num_rows, 7)]
    found = [r for b in ngram_join._buckets(85, 100, most)(iter(batches)) for r in b.to_pylist()]
    met = {frozenset((r["sig"], r["hub"])) for r in found if r["kind"] == 1}
    left = [(r["token"], r["sig"]) for r in found if r["kind"] == 0]
    assert len(left) == len(set(left))
    for token in set(range(60)) - {7}:
        here = {r[2] for r in rows if r[1] == token}
        for x, y in itertools.combinations(here, 2):
            if min(n_of[x], n_of[y]) * 100 >= max(n_of[x], n_of[y]) * 85:
                assert frozenset((x, y)) in met or {(token, x), (token, y)} <= set(left)
    assert sum(r["kind"] == 2 for r in found) == sum(r[0] for r in rows)


def test_tables_for_recall():
    bits, same = 12, 1 - math.acos(0.93) / math.pi
    n = embedding_dedup.tables_for(0.93, bits, 0.99)
    assert 1 - (1 - same ** bits) ** n >= 0.99 > 1 - (1 - same ** bits) ** (n - 1)


def test_crc_of_slices():
    ids = np.arange(10, dtype="<u4")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
