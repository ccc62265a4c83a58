"""Words of whole texts as numpy arrays, straight from Arrow's buffers.

A batch of texts is one array of bytes with offsets. Words are maximal runs of bytes that are
not white space (0x20, 0x09-0x0D); as those bytes never occur inside a multi-byte character,
this equals cutting the decoded text by ``[^\\x20\\x09-\\x0D]+``. Batches are walked in pieces of
a few megabytes, and a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
PIECE_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: rows are the texts' places in the batch."""

    rows: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text, the place of its first word, and one past the last text
    bounds: np.ndarray  # of each text, the place of its first byte, and one past the last text

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64 bits for each word, from its bytes (A-Z lower-cased if asked) and its length."""
        data = _LOWER[self.data] if lower else self.data
        length = self.ends - self.starts
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        out = mix(length.astype(np.uint64) * _M1)
        todo, at, left = np.arange(len(length)), self.starts, length
        while len(todo):
            block = eights[at]
            short = left < 8
            keep = np.where(short, left, 0).astype(np.uint64) * np.uint64(8)
            block = np.where(short, block & ((np.uint64(1) << keep) - np.uint64(1)), block)
            out[todo] = mix((out[todo] ^ block) * _M1)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return out


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about most bytes; at least one row each."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to


def words(column: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[Words]:
    data, off = texts(column)
    for a, b in pieces(off, most):
        piece, bounds = data[off[a]:off[b]], off[a:b + 1] - off[a]
        inside = np.concatenate([~_WHITE[piece], [False]])
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(piece))]
        start[cuts] = inside[cuts]
        end[cuts - 1] = inside[cuts - 1]
        starts = np.flatnonzero(start[:-1])
        yield Words(np.arange(a, b), piece, starts, np.flatnonzero(end[:-1]) + 1, np.searchsorted(starts, bounds), bounds)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list<int64> array over a flat array."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
