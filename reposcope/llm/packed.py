"""Numbers and bytes as compact binary columns, for exchanges that would otherwise be a row per number."""

from __future__ import annotations

import ctypes

import numpy as np
import zstandard


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes (all first bytes, all second bytes, ...)."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((0,), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers, as differences."""
    d = a.copy()
    d[1:] -= a[:-1]
    return pack(d)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task, beside a full JVM heap."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def frugal(run):
    """A group function of one table that gives back its memory."""
    def wrapped(table):
        out = run(table)
        give_back()
        return out
    return wrapped


def frugal_pair(run):
    """A group function of two tables that gives back its memory."""
    def wrapped(left, right):
        out = run(left, right)
        give_back()
        return out
    return wrapped


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column without nulls, end to end, and the len + 1 offsets of its values."""
    import pyarrow as pa

    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], whole.type)
    whole = whole.cast(pa.large_string())
    n = len(whole)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[whole.offset:whole.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]
