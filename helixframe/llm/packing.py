"""Columns of numbers as small blobs, for shuffles of many hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", 1)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return _ZSTD.decompress(blob[8:], size, asbytes=True) if size else b""


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte, the lowest bytes first, without the bytes that all have as 0."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    of = x.astype("<u8").view(np.uint8).reshape(len(x), 8)
    return b"".join([bytes([width]), *(of[:, k].tobytes() for k in range(width))])


def by_byte(x: np.ndarray) -> np.ndarray:
    """A row for each byte of numbers from 0, the lowest bytes first, as far as any is not 0."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :width].T)


def pack(x: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns of numbers from 0, the first ascending."""
    return squeeze(len(x).to_bytes(8, "little") + _planes(np.diff(x, prepend=x[:1] * 0)) + b"".join(_planes(y) for y in others))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns, as unsigned 64-bit numbers."""
    data = unsqueeze(blob)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    while at < len(data):
        width = data[at]
        x = np.zeros((n, 8), np.uint8)
        for k in range(width):
            x[:, k] = np.frombuffer(data, np.uint8, n, at + 1 + k * n)
        out.append(x.reshape(-1).view("<u8"))
        at += 1 + n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out
