"""Vectorised text kernels shared by the corpus operators.

Everything here works on Arrow string columns viewed as one byte buffer plus
row offsets, so a batch of documents costs a fixed number of numpy passes and
no per-word Python.  A *word* is a maximal run of bytes outside
``\\x20 \\x09-\\x0D``; all of those are ASCII, so byte-level splitting agrees
with splitting the decoded text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_INVERSE_BITS = 6


def _odd_inverse(base: int) -> int:
    """Inverse of an odd number modulo 2**64 (Newton's iteration)."""
    x = base
    for _ in range(_INVERSE_BITS):
        x = (x * (2 - base * x)) & 0xFFFFFFFFFFFFFFFF
    return x


class Powers:
    """Growing tables of base**i and base**-i modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = _U(base), _U(_odd_inverse(base))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up = np.full(size, self.base, dtype=np.uint64)
            up[0] = 1
            down = np.full(size, self.inverse, dtype=np.uint64)
            down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_BYTES = (Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F))
_ITEMS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64 bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_chunks(off: np.ndarray, most: int = 1 << 21):
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of buf[start:end] for each span."""
    n = len(buf)
    up, down = _BYTES[which].upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ (end - start).astype(np.uint64) * _U(0x9FB21C651E98DF25))


def window_hash(items: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive 64-bit items."""
    n = len(items)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _ITEMS[which].upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(items * up[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (n + 1 long)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(off), dtype=np.int64)
    solid = ~SPACE[buf]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | fresh[1:n]
    stops = np.zeros(n + 1, dtype=bool)
    stops[1:] = solid
    stops[:-1] &= ~solid | fresh[:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    return start, end, np.searchsorted(start, off)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values (doubling, no loop over width)."""
    out, span = h, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out
