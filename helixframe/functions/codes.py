"""k-mers as numbers: two bits a base, by A < C < T < G, so that they sort as k-mers do.

Up to 31 bases are one long, ``code``.  Up to 64 are two: ``code`` has the first k - 32 bases and
``code2`` the last 32, both as unsigned numbers less 2**63, whose order as longs is that of the k-mers.
Strings are made at the edge only.  Windows are cut, packed and turned to a strand by Arrow tasks, a
piece of a sequence at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kmers import _col, decode, encode, sort_key

PIECE = 1 << 20  # bases of which the windows are packed at once
HELD = 1 << 22  # windows that a task counts together

U64 = np.uint64
_HALF = U64(1 << 63)
_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACTG", np.uint8)] = range(4)


def key_columns(k: int) -> list[str]:
    if not 1 <= k <= 64:
        raise ValueError("k has to be between 1 and 64")
    return ["code"] if k < 32 else ["code", "code2"]


def _halved(c: Column) -> Column:
    return (F.conv(sort_key(c), 4, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def _whole(c: str, n: int) -> Column:
    number = (F.col(c).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string")
    return F.translate(F.lpad(F.conv(number, 10, 4), n, "0"), "0123", "ACTG")


def pack(kmer: Column | str, k: int) -> list[Column]:
    """The key columns of a k-mer."""
    names = key_columns(k)
    if k < 32:
        return [encode(kmer).alias("code")]
    first, last = F.substring(_col(kmer), 1, k - 32), F.substring(_col(kmer), k - 31, 32)
    return [(_halved(first) if k > 32 else F.lit(-(1 << 63))).alias(names[0]), _halved(last).alias(names[1])]


def unpack(k: int) -> Column:
    """The k-mer that the key columns stand for."""
    if k < 32:
        return decode("code", k).alias("kmer")
    last = _whole("code2", 32)
    return (F.concat(_whole("code", k - 32), last) if k > 32 else last).alias("kmer")


def packed(db: DataFrame, k: int) -> DataFrame:
    """A dataset with key columns in place of kmer."""
    return db if "code" in db.columns else db.select(*pack("kmer", k), *[c for c in db.columns if c != "kmer"])


def unpacked(db: DataFrame, k: int) -> DataFrame:
    """A dataset with kmer in place of key columns."""
    return db if "kmer" in db.columns else db.select(unpack(k), *[c for c in db.columns if c not in ("code", "code2")])


def keys_of(db: DataFrame) -> list[str]:
    """The columns that name a dataset's k-mers."""
    return [c for c in ("kmer", "code", "code2") if c in db.columns]


def _number(c: np.ndarray, k: int, n: int, reverse: bool = False) -> np.ndarray:
    """The number of k letters from each of n places on; reverse: the last letter leads.  Put together of powers of two letters."""
    out, have = np.zeros(n, U64), 0
    width, power = 1, c.astype(U64)
    while k:
        if k & width:
            some = power[have : have + n]
            out = out + (some << U64(2 * have)) if reverse else (out << U64(2 * width) if 2 * width < 64 else U64(0)) + some
            have += width
        if 2 * width > k:
            break
        up = U64(2 * width)
        power = power[:-width] + (power[width:] << up) if reverse else (power[:-width] << up) + power[width:]
        width *= 2
    return out


def _words(c: np.ndarray, k: int, strand: str) -> list[np.ndarray]:
    """The words of all windows of the codes c; letters beside A, C, T and G have to be left out after."""
    n = len(c) - k + 1
    first = max(0, k - 32)
    ahead = [_number(c, k, n)] if k < 32 else [_number(c, first, n), _number(c[first:], 32, n)]
    if strand == "forward":
        return ahead
    o = c ^ 2  # complements
    back = [_number(o, k, n, True)] if k < 32 else [_number(o[32:], first, n, True) if first else np.zeros(n, U64), _number(o, 32, n, True)]
    if strand == "reverse":
        return back
    less = back[0] < ahead[0] if k < 32 else (back[0] < ahead[0]) | ((back[0] == ahead[0]) & (back[1] < ahead[1]))
    return [np.where(less, b, a) for a, b in zip(ahead, back, strict=True)]


def _pieces(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, places) of pieces of the sequences of a batch, each between separators, overlapping by k - 1; a place is that of a code among all of the batch and its separators."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return
    letters = np.frombuffer(data, np.uint8)
    at, rows = offsets[0], len(column)
    # separators: one before each sequence
    total = int(offsets[-1] - at) + rows
    starts = offsets[:-1] - at + np.arange(rows)  # of the separators
    for lo in range(0, total, PIECE):
        hi = min(total, lo + PIECE + k - 1)
        i, j = np.searchsorted(starts, [lo, hi])
        inner = starts[i:j] - lo
        begin, end = at + lo - i, at + hi - j
        yield np.insert(_CODES[letters[begin:end]], inner - np.arange(j - i), 4), lo


def _valid(c: np.ndarray, k: int) -> np.ndarray:
    bad = np.concatenate([[0], np.cumsum(c == 4)])
    return np.flatnonzero(bad[k:] == bad[:-k])


def _signed(words: list[np.ndarray], k: int) -> list[np.ndarray]:
    return [(w if k < 32 else w ^ _HALF).view(np.int64) for w in words]


def _stranded(c: np.ndarray, at: np.ndarray, k: int, strand: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places and words of the valid windows; ``both`` has the reverse strand's where they differ, too."""
    if strand != "both":
        return at, [w[at] for w in _signed(_words(c, k, strand), k)]
    ahead, back = ([w[at] for w in _signed(_words(c, k, x), k)] for x in ("forward", "reverse"))
    other = np.logical_or.reduce([a != b for a, b in zip(ahead, back, strict=True)])
    return np.concatenate([at, at[other]]), [np.concatenate([a, b[other]]) for a, b in zip(ahead, back, strict=True)]


def _windows(k: int, strand: str, keep: list[str], sieve=None):
    def f(batches):
        for batch in batches:
            column = batch.column("bases")
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            large = column.cast(pa.large_binary()).fill_null(b"")
            size = np.diff(np.frombuffer(large.buffers()[1], np.int64, len(large) + 1, large.offset * 8)) if len(large) else np.zeros(0, np.int64)
            first = np.concatenate([[0], np.cumsum(size + 1)])[:-1] + 1  # place of each sequence's first base
            for c, lo in _pieces(column, k):
                if len(c) < k:
                    continue
                at, words = _stranded(np.minimum(c, 3), _valid(c, k), k, strand)
                if sieve is not None:
                    pass_ = sieve.value.maybe(words)
                    at, words = at[pass_], [w[pass_] for w in words]
                row = np.searchsorted(first, at + lo, "right") - 1
                columns = [batch.column(x).take(pa.array(row)) for x in keep] + [pa.array(at + lo - first[row]), *map(pa.array, words)]
                out = pa.RecordBatch.from_arrays(columns, names=[*keep, "pos", *key_columns(k)])
                for i in range(0, len(out), 1 << 17):
                    yield out.slice(i, 1 << 17)

    return f


def packed_windows(sequences: DataFrame, k: int, *keep: str, strand: str = "canonical", sieve=None) -> DataFrame:
    """(*keep, pos, code[, code2]): all k-mers of ``bases`` on a strand, with positions from 0; none spans another letter than ACGT.

    strand both: those of the forward strand, and of the reverse one where they differ.  A sieve is a
    broadcast variable of a Sieve: windows that it knows to be in no dataset are left out.
    """
    rows = sequences.select(*keep, "bases")
    kept = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in rows.schema[:-1])
    return rows.mapInArrow(_windows(k, strand, list(keep), sieve), f"{kept}pos long, {', '.join(f'{x} long' for x in key_columns(k))}")


def summed(words: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys and how often each comes (n times each)."""
    order = np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words[::-1])
    words = [w[order] for w in words]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return [w[at] for w in words], count


def _counts(k: int, strand: str, suffix: str):
    ends = None if not suffix else (U64((1 << 2 * len(suffix)) - 1), U64(sum("ACTG".index(x) << 2 * i for i, x in enumerate(reversed(suffix)))))

    def table(words, n):
        return pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(n)], names=[*key_columns(k), "n"])

    def f(batches):
        held, size = [], 0

        def out():
            words, n = summed([np.concatenate(w) for w in zip(*held, strict=True)])
            for i in range(0, len(n), 1 << 18):
                yield table([w[i : i + (1 << 18)] for w in words], n[i : i + (1 << 18)].astype(np.int64))

        for batch in batches:
            column = batch.column("bases")
            for c, _ in _pieces(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, k):
                if len(c) < k:
                    continue
                at = _valid(c, k)
                words = [w[at] for w in _words(np.minimum(c, 3), k, strand)]
                if ends:
                    fits = words[-1] & ends[0] == ends[1]
                    words = [w[fits] for w in words]
                held.append(_signed(words, k))
                size += len(words[0])
                if size > HELD:
                    yield from out()
                    held.clear()
                    size = 0
        if size:
            yield from out()

    return f


def packed_counts(sequences: DataFrame, k: int, strand: str = "canonical", suffix: str = "") -> DataFrame:
    """(code[, code2], n): how often the k-mers of ``bases`` occur, summed over some millions of windows of a task at a time."""
    if len(suffix) > min(k, 31):
        raise ValueError("a suffix has at most k bases, and 31")
    return sequences.select("bases").mapInArrow(_counts(k, strand, suffix), f"{', '.join(f'{x} long' for x in key_columns(k))}, n long")


class Sieve:
    """A Bloom filter of keys with two bits each: it passes all of them, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, int(len(bits) * 32).bit_length() - 1

    @staticmethod
    def places(words: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        x = words[0].view(U64) * U64(0x9E3779B97F4A7C15)
        if len(words) > 1:
            x = (x ^ (x >> U64(32)) ^ words[1].view(U64)) * U64(0xC2B2AE3D27D4EB4F)
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        return (x >> U64(64 - size)).astype(np.int64), ((x * U64(0x94D049BB133111EB)) >> U64(64 - size)).astype(np.int64)

    def maybe(self, words: list[np.ndarray]) -> np.ndarray:
        out = None
        for at in self.places(words, self.size):
            bit = (self.bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            out = bit if out is None else out & bit
        return out


MOST_BITS = 29  # of a sieve: 64 MB
PART = 1 << 12  # words of a sieve in a row


def _sieved(size: int, keys: list[str]):
    def f(batches):
        bits = np.zeros(1 << (size - 5), np.uint32)
        for batch in batches:
            for at in Sieve.places([batch.column(c).to_numpy() for c in keys], size):
                np.bitwise_or.at(bits, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        parts = bits.reshape(-1, min(PART, len(bits)))
        for i in np.flatnonzero(parts.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], names=["part", "words"])

    return f


def _joined(batches):
    """One row a part; rows come sorted by part."""
    part = words = None
    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist(), strict=True):
            if p != part:
                if part is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["part", "words"])
                part, words = p, np.zeros(len(blob) // 4, np.uint32)
            words |= np.frombuffer(blob, np.uint32)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["part", "words"])


def sieve(dbs: list[DataFrame], k: int):
    """A broadcast Sieve of the datasets' k-mers, or None where they are too many for it to help.

    It has 16 bits a k-mer, rounded up, and 2**MOST_BITS at most; beyond 2**MOST_BITS / 4 k-mers half
    of all windows would pass, and there is none.  The datasets are evaluated for it, so they had better be stored.
    """
    keys = key_columns(k)
    every = None
    for db in dbs:
        part = packed(db, k).select(keys)
        every = part if every is None else every.unionByName(part)
    n = every.count()
    if n > 1 << (MOST_BITS - 2):
        return None
    size = min(MOST_BITS, max(12, n.bit_length() + 4))
    spark = every.sparkSession
    bits = np.zeros((max(1, (1 << (size - 5)) // PART), min(PART, 1 << (size - 5))), np.uint32)
    found = every.mapInArrow(_sieved(size, keys), "part int, words binary").repartition("part").sortWithinPartitions("part").mapInArrow(_joined, "part int, words binary")
    for r in found.collect():
        bits[r["part"]] = np.frombuffer(r["words"], np.uint32)
    return spark.sparkContext.broadcast(Sieve(bits.ravel()))
