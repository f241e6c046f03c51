"""Token ids of whole Arrow batches, by the tokenizers library, once per distinct word.

The tokenizer file drops white space and cuts words by rule before its merges
apply, so the ids of a text are those of its white-space-free runs in order. A
run of ASCII and Latin letters (U+00C0 to U+027F) is cut further into letters,
single digits and signs, as the file's own rule does; a run with any other
character, an apostrophe (contractions) or ``<`` (special tokens) goes through
the tokenizer whole. Each distinct run is encoded
once per task while a table of fixed size holds it; the rest is numpy.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np

from mdloom.llm import textbatch as tb

U64 = np.uint64
SLOT_BITS = 19
MOST_IDS = 1 << 22
#: The cutting rule that the finer cut of plain ASCII runs stands for.
KNOWN_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _LETTER
_CLASS[97:123] = _LETTER
_CLASS[[39, 60]] = _OTHER
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0


def _classes(part: np.ndarray) -> np.ndarray:
    kind = _CLASS[part]
    lead = np.flatnonzero((part >= 0xC3) & (part <= 0xC9))  # two bytes: U+00C0 to U+027F, letters but for these two
    if len(lead):
        lead = lead[lead + 1 < len(part)]
        sign = (part[lead] == 0xC3) & ((part[lead + 1] == 0x97) | (part[lead + 1] == 0xB7))
        lead = lead[~sign]
        kind[lead] = _LETTER
        kind[lead + 1] = _LETTER
    return kind


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes for themselves, the rest from U+0100 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        if (cut[0].get("pattern") or {}).get("Regex") != KNOWN_RULE or "Lowercase" not in norm:
            raise ValueError("this tokenizer does not cut lower-case words as WordEncoder does")
        self.letters = _byte_letters()
        self._clear()

    def _clear(self):
        n = 1 << SLOT_BITS
        self.keys, self.at, self.len = np.zeros(n, U64), np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0

    def _cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, hashes of all runs to encode, and which of them are plain."""
        ss, es, hs, ps = [], [], [], []
        for a, b in tb._slices(data):
            part = data[a:b]
            kind = _classes(part)
            n = len(part)
            edge = np.zeros(n + 1, bool)
            lo, hi = np.searchsorted(offs, [a, b])
            edge[offs[lo:hi] - a] = True
            solid = kind != 0
            prev = np.zeros(n, np.uint8)
            prev[1:] = kind[:-1]
            prev[edge[:n]] = 0
            word = np.flatnonzero(solid & (prev == 0))
            if not len(word):
                continue
            odd = np.zeros(n + 1, np.int32)
            np.cumsum(kind == _OTHER, out=odd[1:])
            nxt = np.zeros(n, np.uint8)
            nxt[:-1] = kind[1:]
            nxt[edge[1:]] = 0
            word_end = np.flatnonzero(solid & (nxt == 0)) + 1
            whole = odd[word_end] > odd[word]
            cut = np.flatnonzero(solid & ((kind != prev) | (kind == _DIGIT)))
            at = np.searchsorted(word, cut, side="right") - 1
            keep = ~whole[at] | (cut == word[at])
            starts, at = cut[keep], at[keep]
            ends = np.minimum(np.append(starts[1:], n), word_end[at])
            sums = np.empty(n + 1, U64)
            sums[0] = 0
            np.cumsum((tb.LOWER[part].astype(U64) + U64(1)) * tb._powers(tb._BASE, n), out=sums[1:])
            h = (sums[ends] - sums[starts]) * tb._powers(tb._INVERSE, n)[starts]
            h = tb.mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
            whole = whole[at]
            if (part == 60).any():  # special tokens tell upper from lower case
                less = np.zeros(n + 1, np.int32)
                np.cumsum(part == 60, out=less[1:])
                for i in np.flatnonzero(less[ends] > less[starts]).tolist():
                    h[i] = U64(int.from_bytes(hashlib.blake2b(part[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little"))
            h[h == 0] = 1
            ss.append(starts + a)
            es.append(ends + a)
            hs.append(h)
            ps.append(~whole)
        if not ss:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0, U64), np.empty(0, bool)
        return np.concatenate(ss), np.concatenate(es), np.concatenate(hs), np.concatenate(ps)

    def _one(self, run: bytes, plain: bool) -> list[int]:
        if plain and run.isascii():
            return [t.id for t in self.tokenizer.model.tokenize(run.decode("ascii").lower())]
        text = run.decode("utf-8")
        if plain:
            lower = text.lower()  # these letters are composed already, and lower case is char by char
            if lower.isalpha():
                return [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in lower.encode()]))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, texts: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Encode runs, append their ids to the store; their places and lengths."""
        ids = [self._one(x, plain) for x, plain in texts]
        lens = np.fromiter((len(x) for x in ids), np.int32, len(ids))
        total = int(lens.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(len(self.flat), np.uint32)))
        at = self.used + np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)
        self.flat[self.used:self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.used += total
        return at, lens

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text buffer, and the number of ids of each row."""
        if self.used > MOST_IDS:
            self._clear()
        starts, ends, h, plain = self._cut(data, offs)
        if not len(h):
            return np.empty(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        mask = U64((1 << SLOT_BITS) - 1)
        one, two = (h & mask).astype(np.int64), ((h >> U64(32)) & mask).astype(np.int64)
        slot = np.where(self.keys[one] == h, one, two)
        hit = self.keys[slot] == h
        at, lens = self.at[slot], self.len[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            rows = miss[first]
            buf = data.tobytes() if len(rows) * 16 > len(data) else None
            texts = [((buf[s:e] if buf is not None else data[s:e].tobytes()), p)
                     for s, e, p in zip(starts[rows].tolist(), ends[rows].tolist(), plain[rows].tolist(), strict=True)]
            new_at, new_len = self._new(texts)
            at[miss], lens[miss] = new_at[back], new_len[back]
            where = np.where(self.keys[one[rows]] == 0, one[rows], two[rows])
            self.keys[where] = new
            self.at[where], self.len[where] = new_at, new_len
            # where two new runs met in a slot the last one holds it
            lost = self.keys[where] != new
            self.at[where[~lost]], self.len[where[~lost]] = new_at[~lost], new_len[~lost]
        upto = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        ids = self.flat[np.repeat(at - upto[:-1], lens) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, offs)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per task and file; ``forget`` drops it when the task's batches end."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop the tokenizers and their tables: Spark keeps the worker for other tasks."""
    _ENCODERS.clear()
    tb.release()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
