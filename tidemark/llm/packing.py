"""Arrays of int32 and of strings as compressed bytes, for columns that hold long lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(a: np.ndarray) -> bytes:
    """The four bytes of the numbers apart, compressed: small numbers cost little more than their lowest byte."""
    import zstandard

    planes = np.ascontiguousarray(np.ascontiguousarray(a, dtype=np.int32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).reshape(-1)


def packed_texts(texts: pa.Array) -> bytes:
    """The strings' lengths and their bytes, each compressed; the lengths' size comes first."""
    import zstandard

    texts = pa.concat_arrays([texts])  # offsets from 0
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[: len(texts) + 1]
    lengths = packed(np.diff(ends))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(b"" if data is None else memoryview(data)[int(ends[0]) : int(ends[-1])])


def unpacked_texts(b: bytes) -> pa.Array:
    import zstandard

    n = int.from_bytes(b[:4], "little")
    lengths = unpacked(b[4 : 4 + n])
    ends = np.append(np.int32(0), np.cumsum(lengths, dtype=np.int32))
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(zstandard.ZstdDecompressor().decompress(b[4 + n :]))])
