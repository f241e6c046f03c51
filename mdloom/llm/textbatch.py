"""Words and shingles of whole Arrow batches with numpy, used inside Spark tasks.

A batch of texts is read as one byte buffer plus row offsets, without a Python
object per word. A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased,
so UTF-8 bytes decide alone. Word hashes are 64-bit: a polynomial over the
word's bytes modulo 2**64, mixed with its length. Work runs over slices of
about ``SLICE`` bytes cut at white space, so that a very long text costs memory
in proportion to its number of words, not a multiple of its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 4096)
        have = np.empty(size, dtype=U64)
        have[0] = 1
        done = 1
        step = np.array([base % (1 << 64)], dtype=U64)  # base**done
        while done < size:
            m = min(done, size - done)
            have[done:done + m] = have[:m] * step
            step = step * step
            done += m
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets (nulls are empty)."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def _slices(data: np.ndarray, size: int = SLICE, space: np.ndarray = IS_SPACE) -> Iterator[tuple[int, int]]:
    """Cuts behind white space, about ``size`` bytes each."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        while end < n:
            found = np.flatnonzero(space[data[end - 1:min(n, end + 65536)]])
            if len(found):
                end = end - 1 + int(found[0]) + 1
                break
            end = min(n, end + 65536)
        yield at, min(end, n)
        at = min(end, n)


class Words:
    """hashes, byte starts and ends of all words; row i has words offs[i]:offs[i+1]."""

    def __init__(self, hashes, starts, ends, offs):
        self.hashes, self.starts, self.ends, self.offs = hashes, starts, ends, offs

    def __len__(self):
        return len(self.hashes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = IS_SPACE) -> Words:
    """All words: runs of bytes that ``space`` (a flag per byte) does not hold."""
    hs, ss, es = [], [], []
    for a, b in _slices(data, space=space):
        part = data[a:b]
        n = len(part)
        solid = ~space[part]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = solid[:-1]
        lo, hi = np.searchsorted(offs, [a, b])
        edges = offs[lo:hi] - a
        edges = edges[(edges >= 0) & (edges < n)]
        before[edges] = False
        first = solid & ~before
        # a word also ends where the next row begins
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = solid[1:]
        inner = edges[edges > 0] - 1
        after[inner] = False
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(solid & ~after) + 1
        if a and len(starts) and solid[0] and not space[data[a - 1]] and a not in offs:
            raise AssertionError("a slice starts inside a word")
        sums = np.empty(n + 1, dtype=U64)
        sums[0] = 0
        np.cumsum((LOWER[part].astype(U64) + U64(1)) * _powers(_BASE, n), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts]
        hs.append(mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))
        ss.append(starts + a)
        es.append(ends + a)
    if not hs:
        return Words(np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64))
    starts = np.concatenate(ss)
    return Words(np.concatenate(hs), starts, np.concatenate(es), np.searchsorted(starts, offs))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (positions 0 .. len-k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    acc = np.zeros(n, U64)
    for j in range(k):
        acc = acc * U64(0xA0761D6478BD642F) + h[j:j + n]
    return mix(acc)


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word runs; a row of fewer
    words has one, of all its words; a row without words none."""
    full = runs(w.hashes, k)
    for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(full[a:b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield s
        elif b > a:
            yield runs(w.hashes[a:b], b - a) ^ U64(b - a)
        else:
            yield np.empty(0, U64)


#: Only glibc has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give what finished work left in this worker's pools back to the system: Spark keeps
    workers for later tasks, and their free memory counts against the executor's."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batches: Iterator[pa.RecordBatch], name: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most`` bytes (a longer text alone)."""
    release()
    for batch in batches:
        _, offs = text_buffer(column(batch, name))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release()


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)
