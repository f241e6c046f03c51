"""Paragraphs of long lines: cut by content, each line by itself."""

import random
import time

import numpy as np
import pytest

from mdloom.llm import fingerprints as fp


def text_of(seed: int, n: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz  ") -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


def alike(a: str, b: str) -> float:
    return fp.likeness(fp.vector(fp.paragraphs(a)), fp.vector(fp.paragraphs(b)))


def brute(line: str) -> list[str]:
    """The rule place by place: the hash of the next WINDOW characters against those of RADIUS places on either side."""
    codes = np.array([ord(c) for c in line], np.uint64)
    h = [int(fp.tb.runs(codes[i:i + fp.WINDOW], fp.WINDOW)[0]) for i in range(len(line) - fp.WINDOW + 1)]
    least = [min(h[j] for j in range(max(0, i - fp.RADIUS), min(len(h), i + fp.RADIUS + 1)) if j != i) for i in range(len(h))]
    out, x = [], 0
    for y in [*(i for i in range(1, len(h)) if h[i] < least[i]), len(line)]:
        while y - x > fp.MOST:
            z = next((i for i in range(x + fp.LONG, x + fp.MOST) if i < len(h) and h[i] <= least[i]), x + fp.MOST)
            out.append(line[x:z])
            x = z
        out.append(line[x:y])
        x = y
    return out


@pytest.mark.parametrize("alphabet", ["abcdefgh ", "ab", "a", "é😀日 \udc80x"])
def test_cuts_equal_the_rule(alphabet):
    for n in (65, 66, 90, 700):
        for line in (text_of(n, n, alphabet), text_of(n, 5, alphabet) * n):
            assert fp.paragraphs(line) == brute(line) and "".join(brute(line)) == line


def test_spans_of_any_size_give_the_same_cuts(monkeypatch):
    text = "\n".join([text_of(1, 5000), "short", text_of(2, 64), text_of(3, 65), "", text_of(4, 3000)])
    whole = fp.paragraphs(text)
    for span in (1, 7, 64, 1000):
        monkeypatch.setattr(fp, "SPAN", span)
        assert fp.paragraphs(text) == whole


def test_lines_are_cut_by_themselves():
    lines = [text_of(i, 40 + 37 * i) for i in range(30)]
    want = sorted(p for line in lines for p in fp.paragraphs(line))
    assert sorted(fp.paragraphs("\n".join(lines))) == want == sorted(fp.paragraphs("\n".join(reversed(lines))))
    assert alike("\n".join(lines), "\n".join(reversed(lines))) == 1.0


def test_one_character_changes_few_paragraphs():
    for seed in range(60):
        text = text_of(seed, 2000 + 50 * seed)
        own = sorted(fp.paragraphs(text))
        at = random.Random(seed).randrange(len(text))
        for new in ("x" + text, text[1:], text[:at] + "Q" + text[at:], text[:at] + text[at + 1:]):
            assert alike(text, new) >= 0.85
            parts = fp.paragraphs(new)
            for p in own:
                if p in parts:
                    parts.remove(p)
            assert len(parts) <= 4


def test_one_character_before_words_said_over_and_over():
    for word, n in (("Der ", 600), ("Tior, ", 400), ("Thsh ", 420), ("a", 2500), ("and so on ", 300)):
        text = word * n + "beiever " * 300
        assert alike(text, "q" + text) >= 0.85 and alike(text, "Der" + text[1:]) >= 0.85


def test_repeated_characters_and_long_lines():
    start = time.monotonic()
    same = fp.paragraphs("a" * 1_000_000)
    assert max(map(len, same)) <= fp.MOST and len(same) < 20000
    line = text_of(5, 1_000_000)
    parts = fp.paragraphs(line)
    assert "".join(parts) == line and max(map(len, parts)) <= fp.MOST and 25 < len(line) / len(parts) < 45
    assert time.monotonic() - start < 20
    assert fp.paragraphs("") == [] and fp.paragraphs("x" * 64) == ["x" * 64] and fp.paragraphs("a\n\nb") == ["a", "", "b"]
