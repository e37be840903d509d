"""Words of whole texts as 64-bit hashes, for whole Arrow columns at a time.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashing works on the UTF-8
bytes of a column in a few vectorised passes, so no Python string is made per word."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20            # bytes hashed at once; longer texts are cut at white space
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD1342543DE82EF95)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _BYTES[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Hashes of all words of some texts; text i has words offsets[i] to offsets[i + 1]."""
    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _hash_slice(data: np.ndarray, starts_of_texts: np.ndarray, table: np.ndarray):
    n = len(data)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[starts_of_texts] = True
    first = word & np.concatenate(([True], ~word[:-1] | cut[1:n]))
    last = word & np.concatenate((~word[1:] | cut[1:n], [True]))
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    total = np.cumsum(table[data] * _powers(_BASE, n), dtype=np.uint64)
    span = total[end] - np.where(begin > 0, total[begin - 1], np.uint64(0))
    hashes = mix(span * _powers(_INVERSE, n)[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, starts_of_texts)


def _end_of_slice(data: np.ndarray, at: int, end: int) -> int:
    """First white space at `at` or later, or `end`."""
    for i in range(at, end, SLICE_BYTES):
        found = np.flatnonzero(_SPACE[data[i:min(i + SLICE_BYTES, end)]])
        if len(found):
            return i + int(found[0])
    return end


def _hash_long(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Word hashes of one text, slice by slice."""
    out, at = [], 0
    while at < len(data):
        end = _end_of_slice(data, min(at + SLICE_BYTES, len(data)), len(data))
        out.append(_hash_slice(data[at:end], np.zeros(1, np.int64), table)[0])
        at = end
    return np.concatenate(out)


def words_of(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Word hashes of a string column; null is an empty text, `lower` folds A-Z only."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(1, np.int64))
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    table, hashes, offsets, done, i = _LOWER if lower else _BYTES, [], [np.zeros(1, np.int64)], 0, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        if j == i + 1 and at[j] - at[i] > SLICE_BYTES:
            part, before = _hash_long(data[at[i]:at[j]], table), np.zeros(1, np.int64)
        elif at[j] > at[i]:
            part, before = _hash_slice(data[at[i]:at[j]], at[i:j] - at[i], table)
        else:
            part, before = np.zeros(0, np.uint64), np.zeros(j - i, np.int64)
        hashes.append(part)
        offsets.append(done + np.append(before[1:], len(part)))
        done, i = done + len(part), j
    return Words(np.concatenate(hashes), np.concatenate(offsets).astype(np.int64))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all k-word windows inside one text, and their hashes."""
    n = len(words.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total *= _GRAM
        total += words.hashes[j:n + j]
    left = np.repeat(words.offsets[1:], words.counts)[:n] - np.arange(n)
    start = np.flatnonzero(left >= k)
    return start, mix(total[start])


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles; a text of fewer words is one shingle."""
    start, hashes = grams(words, k)
    bounds = np.searchsorted(start, words.offsets)
    for i, n in enumerate(words.counts):
        if n >= k:
            yield np.unique(hashes[bounds[i]:bounds[i + 1]])
        elif n:
            yield grams(Words(words.hashes[words.offsets[i]:words.offsets[i + 1]], np.array([0, n])), int(n))[1]
        else:
            yield np.zeros(0, np.uint64)
