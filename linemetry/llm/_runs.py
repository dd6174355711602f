"""Runs of bytes of one kind in the texts of an Arrow column, by numpy over slices of whole documents.

Only ASCII bytes divide runs, so a run of UTF-8 is whole characters. Slices are bounded in bytes;
one document is never cut, so a slice is larger only where one text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of a byte: part of a run, between runs, and between runs of different pieces.
SOLID, GAP, BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of every byte; all that isn't named is solid."""
    out = np.zeros(256, dtype=np.uint8)
    out[list(gaps)] = GAP
    out[list(breaks)] = BREAK
    return out


@dataclass
class Runs:
    """Runs of the documents first..stop of a batch, in text order, A-Z lower-cased."""

    first: int
    stop: int
    words: pa.LargeStringArray
    doc: np.ndarray  # number in the slice
    piece: np.ndarray  # grows where a break or another document lies between

    @property
    def size(self) -> int:
        return self.stop - self.first


def runs(texts: pa.Array, kind: np.ndarray, slice_bytes: int) -> Iterator[Runs]:
    """Split a string column; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n, first = len(texts), 0
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    while first < n:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, side="right")) - 1)
        yield _split(first, stop, raw[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first], kind)
        first = stop


def _split(first: int, stop: int, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Runs:
    n, of = len(data), kind[data]
    solid = of == SOLID
    border = np.zeros(n + 1, dtype=bool)  # a document begins here
    border[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1] | border[1:n]
        ends[:-1] &= ~solid[1:] | border[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    piece = doc
    if (kind == BREAK).any():
        piece = np.cumsum(of == BREAK)[start] + doc
    places = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=places[1:])
    letters = _LOWER[data[solid]]
    return Runs(first, stop, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(letters)), doc, piece)
