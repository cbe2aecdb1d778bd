"""Words and word n-grams of Arrow string columns as 64-bit hashes, computed without a Python object per word.

A word is a run of bytes outside [\\x20\\x09-\\x0D]; A-Z are lower-cased first.  A word is hashed eight
bytes at a time, all words of a chunk at once.  Two different n-grams share a 64-bit hash with a
probability of about 2**-60, which the operators built on this accept and state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_INSIDE = bytes(b not in (9, 10, 11, 12, 13, 32) for b in range(256))
#: Of a word's last eight bytes, those of the word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of consecutive rows: hash of each word, bounds[i]:bounds[i+1] are row i's; start/end are byte places in the row."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n-grams and their bounds by row (rows of fewer than n words have none)."""
        return ngrams(self.hashes, self.bounds, n)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(np.diff(bounds) - (n - 1), 0)
    out = np.concatenate(([0], np.cumsum(size)))
    if len(hashes) < n:
        return np.zeros(0, np.uint64), out
    h = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        h = h * _STEP + hashes[k : len(hashes) - n + 1 + k]
    h = mix(h + _U(n))
    at = np.repeat(bounds[:-1] - out[:-1], size) + np.arange(out[-1])
    return h[at], out


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole short sequence."""
    h = np.zeros(1, np.uint64)
    for x in hashes:
        h = h * _STEP + x
    return mix(h + _U(len(hashes)))[0]


def words(column: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    """Words of all rows, in chunks of rows of about CHUNK_BYTES (a longer row is a chunk of its own)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        last = min(last, len(column))
        yield _chunk(row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def _chunk(first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    raw = data.tobytes()
    inside = np.frombuffer(raw.translate(_INSIDE), bool)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets)
    base = np.repeat(offsets[:-1], np.diff(bounds))
    return Words(first, _hash(np.frombuffer(raw.translate(_LOWER), np.uint8), start, end - start), bounds, start - base, end - base)


def _hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of stretches of data.  The bytes at any place, read as one little-endian number of eight bytes, are a view of the data."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    out = length.astype(np.uint64) * _ODD
    at, left, which = start, length, None
    while len(at):
        block = mix(eights[at] & _MASK[np.minimum(left, 8)])
        if which is None:
            out = mix(out ^ block)
        else:
            out[which] = mix(out[which] * _ODD ^ block)
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    return out
