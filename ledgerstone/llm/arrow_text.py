"""Byte-level views of Arrow string columns and vectorised word hashing.

Everything works on one Arrow batch at a time, in slices of about
``SLICE_BYTES`` so that the NumPy temporaries stay small whatever the batch.
A single text larger than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: The white space of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the polynomial hashes (mod 2^64) and the finaliser.
BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_powers = {}


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (with the total last)."""
    solid = ~SPACE[buf]
    prev = np.empty_like(solid)
    if len(buf):
        prev[0] = False
        prev[1:] = solid[:-1]
        inner = offsets[:-1][offsets[:-1] < len(buf)]
        first = solid & ~prev
        first[inner] = solid[inner]
        nxt = np.empty_like(solid)
        nxt[-1] = False
        nxt[:-1] = solid[1:]
        last = solid & ~nxt
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = solid[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` mod 2^64 for i < n, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES + 64)
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: int = BASE) -> np.ndarray:
    up, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    _, down = powers(base, len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; long buffers are taken a slice of words at a time."""
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE_BYTES, "right")))
        a, b = starts[lo], ends[hi - 1]
        out[lo:hi] = span_hash(prefix_hash(buf[a:b] + np.uint64(1)), starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k values, by position of the first."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(GRAM_BASE) + hashes[j : j + n]
    return mixed(out)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
