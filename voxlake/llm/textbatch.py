"""Whole Arrow batches of text as byte arrays: words and their hashes without a Python string.

Texts stay in the Arrow buffers.  Work goes in slices of about a MB of whole documents, so memory is
bounded by the slice (or by the longest single document).  A 64-bit word hash is a polynomial over its
bytes, taken from one running sum over the slice, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim, _LIBC.mallopt
except (OSError, AttributeError):  # another C library
    _LIBC = None

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes of words: all but ASCII white space; letters, digits and all non-ASCII bytes.
NOT_SPACE = ~_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = _set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

#: Bytes with A-Z folded to a-z, and as they are.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
EXACT = bytes(range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values, by sorting (NumPy's own way by hashing is several times slower here)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    up, down = _POWERS["up"], _POWERS["down"]
    if n > 8 * SLICE_BYTES:  # one very long text: don't keep its tables
        _POWERS.clear()
    return up, down


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(col: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes): runs of whole texts of at most ``limit`` bytes, or one text."""
    off, data = buffers(col)
    limit = limit or SLICE_BYTES
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j
    release()


def release() -> None:
    """Give freed memory back: workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def keep() -> None:
    """Take arrays of up to 32 MB from memory freed before, up to 256 MB of it, not from fresh pages; ``release`` gives it back."""
    if _LIBC is not None:
        _LIBC.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        _LIBC.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


@dataclass
class Words:
    """Words of a slice: ``first[d] .. first[d+1]`` are those of document d."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray, fold: bytes | None = FOLDED, cut: np.ndarray | None = None) -> Words:
    """Maximal runs of ``inside`` bytes; no run crosses a document's edge, nor goes on at a byte marked in ``cut``.

    ``fold``: what bytes count as for the hashes; None leaves the hashes out.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    raw = data.tobytes()
    w = np.frombuffer(raw.translate(inside.tobytes()), bool)
    joined = np.zeros(n + 1, bool)  # with the byte before
    np.logical_and(w[1:], w[:-1], out=joined[1:n])
    joined[offsets] = False
    if cut is not None:
        joined[:n] &= ~cut
    starts, ends = np.flatnonzero(w & ~joined[:n]), np.flatnonzero(w & ~joined[1:]) + 1
    if fold is None:
        h = np.zeros(0, np.uint64)
    else:
        sums, down = running(np.frombuffer(raw.translate(fold), np.uint8).astype(np.uint64) + np.uint64(1))
        h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(starts, ends, np.searchsorted(starts, offsets), h)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each character, its code point) of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[at].astype(np.int64)
    n = 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)
    point = np.where(n == 1, b, b & (0xFF >> (n + 1)))
    for i in (1, 2, 3):
        more = n > i
        point[more] = (point[more] << 6) | (data[at[more] + i] & 0x3F)
    return at, point


def running(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sums, inverse powers): ``(sums[b] - sums[a]) * down[a]`` hashes codes a .. b - 1 wherever they stand."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums, down


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, ``len(h) - k + 1`` of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9DDFEA08EB382D69) + h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(k))
