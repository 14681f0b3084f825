"""Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the n + 1 offsets into them; a null is an empty value."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, offsets, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(offsets: np.ndarray, rows: int, size: int):
    """Row ranges of at most so many rows, and of about so many bytes; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def packed(x: np.ndarray) -> bytes:
    """Small numbers as a byte each; 255 stands for one that follows after all bytes."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.uint32).tobytes()


def unpacked(data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The n numbers at the front of the bytes, and how many bytes they take."""
    x = data[:n].astype(np.uint32)
    large = np.flatnonzero(data[:n] == 255)
    end = n + 4 * len(large)
    x[large] = data[n:end].view(np.uint32)
    return x, end
