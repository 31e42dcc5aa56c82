"""Texts of an Arrow batch as one flat byte array, and words, lines and hashes found in it with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D (the pattern ``[^\\x20\\x09-\\x0D]+``);
only A-Z are lower-cased.  A null text counts as empty.  Work goes through slices of a few MB, so
memory does not follow the size of the Arrow batch; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
U = np.uint64

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


#: A random value for each byte at each of 64 places of a word; further places reuse them, multiplied.
PLACES = 64
_TABLE = stream(1, PLACES * 256)
_FAR = stream(2, 1)[0] | U(1)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about `most` bytes; a longer row stands alone."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(keep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true values that do not cross a text's border."""
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = keep.copy(), keep.copy()
    start[1:] &= ~keep[:-1]
    end[:-1] &= ~keep[1:]
    first = off[:-1][off[:-1] < off[1:]]
    start[first] = keep[first]
    last = off[1:][off[:-1] < off[1:]] - 1
    end[last] = keep[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and its text's number."""
    starts, ends = runs(~WHITE[data], off)
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run (runs are neither empty nor overlapping)."""
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    value = data[np.repeat(starts, size) + place]
    if int(size.max()) <= PLACES:
        got = _TABLE[(place << 8) | value]
    else:
        got = _TABLE[((place % PLACES) << 8) | value]
        turn = place // PLACES
        far = np.ones(int(turn.max()) + 1, U)
        far[1:] = np.cumprod(np.full(len(far) - 1, _FAR, U), dtype=U)
        got = got * far[turn]
    return mix(np.add.reduceat(got, first) + size.astype(U))


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k successive words of a text, and the number of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = np.zeros(len(at), U)
    for j in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[at + j])
    return out, at
