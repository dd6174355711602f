"""Vectorised word splitting and hashing shared by the text operators.

A word is a run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text. All work is done
with numpy over slices of an Arrow batch, so no Python code runs per word. Slices are bounded
in bytes; one document is never cut, so a slice is larger only where one text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 20
#: Documents in a slice at most, so that a slice-local number fits in 12 bits.
SLICE_DOCS = 4095

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of the documents first..stop of a batch, in text order."""

    first: int
    stop: int
    data: np.ndarray  # the bytes, lower-cased if asked for
    offsets: np.ndarray  # of the documents in data
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # number in the slice
    counts: np.ndarray  # words of each document
    heads: np.ndarray  # number of each document's first word
    hash: np.ndarray


def slices(texts: pa.Array, lower: bool, hashed: bool = True) -> Iterator[Words]:
    """Split a string column into slices of whole documents; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        stop = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        stop = min(n, max(first + 1, min(stop, first + SLICE_DOCS)))
        yield _split(first, stop, raw[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first], lower, hashed)
        first = stop


def _split(first: int, stop: int, data: np.ndarray, offsets: np.ndarray, lower: bool, hashed: bool) -> Words:
    n = len(data)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    border = np.zeros(n + 1, dtype=bool)  # a document begins here
    border[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1] | border[1:n]
        ends[:-1] &= ~solid[1:] | border[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    counts = np.bincount(doc, minlength=stop - first)
    h = np.zeros(0, np.uint64)
    if hashed:
        up, down = _power(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(first, stop, data, offsets, start, end, doc, counts, np.cumsum(counts) - counts, h)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one document, and the numbers of their first words."""
    m = len(w.hash) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:m] == w.doc[k - 1 :])
    h = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + w.hash[j : m + j]
    return mix(h[at], k), at


#: Bits of a shingle's number.
GRAM_BITS = 52


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each document: (document in the slice, 52-bit number), sorted.

    A document of fewer than k words, but at least one, has its whole word sequence as its only
    shingle; one without words has none.
    """
    h, at = windows(w, k)
    doc, grams = [w.doc[at]], [h]
    for n in range(1, k):
        short = np.flatnonzero(w.counts == n)
        if len(short):
            x = np.zeros(len(short), dtype=np.uint64)
            for j in range(n):
                x = x * np.uint64(_BASE) + w.hash[w.heads[short] + j]
            doc.append(short)
            grams.append(mix(x, 1000 + n))
    key = np.concatenate(doc).astype(np.uint64) << np.uint64(GRAM_BITS)
    key |= np.concatenate(grams) >> np.uint64(64 - GRAM_BITS)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(GRAM_BITS)).astype(np.int64), key & np.uint64((1 << GRAM_BITS) - 1)
