"""Vectorised text helpers that run inside Arrow tasks.

A batch of strings is seen as one byte buffer with offsets.  Words are found
and hashed for many documents at once with numpy; a document that is longer
than a piece is hashed piece by piece, so memory stays bounded by the piece
plus eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes handled at once

U64 = np.uint64
MASK = (1 << 64) - 1
_rng = np.random.default_rng(0x5EED)
VALUES = _rng.integers(0, MASK, 256, dtype=U64, endpoint=True)
LOWER_VALUES = VALUES.copy()
LOWER_VALUES[65:91] = VALUES[97:123]

#: Words are ``[^\x20\x09-\x0D]+``.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = False
#: Terms are runs of ASCII letters and digits and of all non-ASCII characters.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[48:58] = TERM_BYTES[65:91] = TERM_BYTES[97:123] = TERM_BYTES[128:] = True

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers = {"p": np.ones(1, U64), "i": np.ones(1, U64)}


def _pow(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base (p) or of its inverse (i), modulo 2**64."""
    have = _powers[kind]
    if len(have) < n:
        n = max(n, PIECE)
        have = np.full(n, _P if kind == "p" else _PINV, U64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8), offsets


def groups(offsets: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``piece`` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + piece, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """Words of the rows i..j of a buffer: byte spans, hashes, and where each row's words begin."""

    __slots__ = ("starts", "ends", "hashes", "first")

    def __init__(self, starts, ends, hashes, first):
        self.starts, self.ends, self.hashes, self.first = starts, ends, hashes, first


def words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, chars: np.ndarray = WORD_BYTES, values: np.ndarray = VALUES) -> Words:
    lo, hi = int(offsets[i]), int(offsets[j])
    bounds = offsets[i : j + 1] - lo
    parts = []
    at = lo
    while at < hi:
        to = min(hi, at + 4 * PIECE)
        if to < hi:  # cut long rows between words
            cut = to
            while cut > at and chars[data[cut - 1]]:
                cut -= 1
            while cut == at and to < hi and chars[data[to]]:
                to += 1
            to = cut if cut > at else to
        parts.append(_piece(data[at:to], bounds - (at - lo), at - lo, chars, values))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), np.zeros(len(bounds), np.int64))
    starts, ends, hashes = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
    return Words(starts + lo, ends + lo, hashes, np.searchsorted(starts, bounds))


def _piece(b: np.ndarray, bounds: np.ndarray, base: int, chars: np.ndarray, values: np.ndarray):
    n = len(b)
    w = chars[b]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(values[b] * _pow("p", n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _pow("i", n)[starts] + (ends - starts).astype(U64))
    return starts + base, ends + base, hashes


_Q = U64(0xD6E8FEB86659FD93)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; of the whole sequence if it is shorter; none without words."""
    n = len(h)
    if n == 0:
        return h
    m = min(n, k)
    out = h[: n - m + 1].copy()
    for i in range(1, m):
        out *= _Q
        out += h[i : n - m + 1 + i]
    return mix(out + U64(m))


def rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
