"""Arrays of numbers as short byte strings, for tables with a row per task instead of a row per number.

Each array is cut to the bytes that its largest number needs. The first bytes of all numbers come first, then the
second ones and so on, which Zstandard shortens well when most numbers are small.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

HEAD = struct.Struct("<qqB")  # numbers, bytes that follow, bytes of a number


def packed(*arrays: np.ndarray) -> bytes:
    """Integers, truth values and float64 numbers; floats are kept bit by bit."""
    out = []
    for values in arrays:
        values = np.asarray(values)
        raw = np.ascontiguousarray(values if values.dtype == np.float64 else values.astype(np.int64)).view(np.uint64)
        width = (int(raw.max()).bit_length() + 7) // 8 if len(raw) else 0
        body = b""
        if width:
            planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, :width].T)
            body = pa.compress(planes, codec="zstd", asbytes=True)
        out += HEAD.pack(len(raw), len(body), width), body
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays as int64; a float array is ``.view(np.float64)`` of its own."""
    at, out = 0, []
    while at < len(blob):
        n, size, width = HEAD.unpack_from(blob, at)
        at += HEAD.size
        raw = np.zeros((n, 8), np.uint8)
        if width:
            planes = pa.decompress(memoryview(blob)[at : at + size], n * width, codec="zstd")
            raw[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
        out.append(raw.view(np.int64).ravel())
        at += size
    return out


def gaps(values: np.ndarray) -> np.ndarray:
    """The first of ascending numbers and the steps between them; ``np.cumsum`` gives them back."""
    return np.diff(values, prepend=0) if len(values) else values


def joined(blobs: list[bytes], n: int) -> list[np.ndarray]:
    """The arrays of several strings of ``n`` arrays each, one behind the other."""
    parts = [unpacked(blob) for blob in blobs]
    return [np.concatenate([np.zeros(0, np.int64), *(part[i] for part in parts)]) for i in range(n)]
