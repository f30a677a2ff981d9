"""Counting by super-k-mers: windows with one minimiser travel together.

The minimiser of a window is the least of its m-mers, on either strand, by a hash.  Consecutive windows
that share it are one string, two bits a base, that goes to the minimiser's bucket; a k-mer and its reverse
complement always have the same, so that a bucket holds all of a k-mer's occurrences.  A bucket's partition cuts
the strings into windows again and counts them a bucket or a few at a time, without another shuffle.

The strings are stored first, so that buckets can be weighed: one with more windows than a partition's
share, or than a task sorts at once, as of low-complexity sequences, is dealt to as many partitions as it fills,
and the parts' counts are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import key_columns, saturate, unpacked
from ..functions.codes import HELD, U64, _pieces, _signed, _valid, _words, summed
from ..sources.stored import new_path

LONGEST = 255  # windows of a string
TOGETHER = 1 << 20  # windows of small buckets that are counted together, about
_ZSTD = pa.Codec("zstd", 1)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive numbers."""
    width = 1
    while 2 * width <= w:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(31)
    x *= U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(29))


def super_kmers(c: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, hash of the minimiser) of each run of windows over the codes c that share a minimiser."""
    at = _valid(c, k) if len(c) >= k else np.zeros(0, np.int64)
    if not len(at):
        return at, at, np.zeros(0, U64)
    least = _least(_mixed(_words(np.minimum(c, 3), m, "canonical")[0]), k - m + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    run = np.arange(len(at)) - first[np.cumsum(new) - 1]
    new |= run % LONGEST == 0
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), least[first]


def _packed(c: np.ndarray, first: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Four bases a byte; each string begins a byte."""
    size = -(-letters // 4)
    cut = np.concatenate([[0], np.cumsum(4 * size)])
    inside = np.arange(cut[-1]) - np.repeat(cut[:-1], 4 * size)
    base = np.where(inside < np.repeat(letters, 4 * size), c[np.minimum(np.repeat(first, 4 * size) + inside, len(c) - 1)], 0).reshape(-1, 4)
    return (base[:, 0] << 6 | base[:, 1] << 4 | base[:, 2] << 2 | base[:, 3]).astype(np.uint8)


def _sent(k: int, m: int, buckets: int):
    """(bucket, n, blob): the strings of a bucket that a task has made of some millions of windows."""

    def f(batches):
        held, size = [], 0

        def out():
            bucket, windows = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            data = np.concatenate([h[2] for h in held])
            bytes_ = -(-(windows + k - 1) // 4)
            begin = np.concatenate([[0], np.cumsum(bytes_)])[:-1]
            order = np.argsort(bucket, kind="stable")
            bucket, windows, begin, bytes_ = bucket[order], windows[order], begin[order], bytes_[order]
            to = np.concatenate([[0], np.cumsum(bytes_)])
            data = data[np.repeat(begin - to[:-1], bytes_) + np.arange(to[-1])]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(bucket))
            blobs = []
            for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
                raw = windows[a:b].astype(np.uint8).tobytes() + data[to[a] : to[b]].tobytes()
                blobs.append(_closed(raw, b - a))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(np.add.reduceat(windows, cut)), pa.array(blobs, pa.binary())], names=["bucket", "n", "blob"])

        for batch in batches:
            column = batch.column("bases")
            for c, _ in _pieces(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, k):
                first, windows, least = super_kmers(c, k, m)
                if len(first):
                    held.append(((least % U64(buckets)).astype(np.int64), windows, _packed(c, first, windows + k - 1)))
                    size += int(windows.sum())
                    if size > HELD:
                        yield from out()
                        held.clear()
                        size = 0
        if held:
            yield from out()

    return f


def _closed(raw: bytes, n: int) -> bytes:
    """A blob of n strings."""
    return len(raw).to_bytes(4, "little") + n.to_bytes(4, "little") + _ZSTD.compress(raw, asbytes=True)


def _opened(blob: bytes, k: int) -> np.ndarray:
    """The codes of a blob's strings, each after a separator."""
    raw = _ZSTD.decompress(blob[8:], int.from_bytes(blob[:4], "little"), asbytes=True)
    n = int.from_bytes(blob[4:8], "little")
    letters = np.frombuffer(raw, np.uint8, n).astype(np.int64) + k - 1
    data = np.frombuffer(raw, np.uint8, -1, n)
    codes = np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], 1).ravel()
    size = 4 * -(-letters // 4)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    inside = np.arange(size.sum()) - np.repeat(begin, size)
    codes = np.where(inside < np.repeat(letters, size), codes, 4).astype(np.uint8)
    return np.insert(codes, begin, 4)


def _cut(k: int, strand: str, split: bool):
    """(keys, n) of the windows of blobs, which come sorted by bucket; a bucket's are summed together, or, of split ones, those of some millions."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def out():
            words, n = summed([np.concatenate(w) for w in zip(*held, strict=True)])
            for i in range(0, len(n), 1 << 18):
                cut = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([*(pa.array(w[cut]) for w in words), pa.array(n[cut].astype(np.int64))], names=[*key_columns(k), "n"])

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if size > HELD if split else size > TOGETHER and bucket != last:
                    yield from out()
                    held.clear()
                    size = 0
                last = bucket
                c = _opened(blob.as_py(), k)
                at = _valid(c, k)
                held.append(_signed([w[at] for w in _words(np.minimum(c, 3), k, strand)], k))
                size += len(at)
        if size:
            yield from out()

    return f


def count_superkmers(sequences: DataFrame, k: int, m: int | None = None, buckets: int | None = None, keys: bool = False, strand: str = "canonical") -> DataFrame:
    """(kmer, value) as count_kmers() gives them; m is the minimisers' length, up to 15, and longer for longer k-mers if not given.

    The strings are written to the shared folder (see sources.stored), some two bits a base and a string's rest.
    """
    m = min(k, 15, max(9, k // 2 + 1)) if m is None else m
    if not 1 <= m <= min(k, 15):
        raise ValueError("m has to be between 1 and k, and 15 at most")
    spark, names = sequences.sparkSession, key_columns(k)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or min(1 << 20, max(256, 16 * parts))
    schema = f"{', '.join(f'{c} long' for c in names)}, n long"
    path = new_path(spark, "super-kmers")
    sequences.select("bases").mapInArrow(_sent(k, m, buckets), "bucket long, n long, blob binary").write.parquet(path)
    sent = spark.read.schema("bucket long, n long, blob binary").parquet(path)
    total = sent.agg(F.sum("n")).first()[0] or 0
    share = min(HELD, max(1 << 16, -(-total // parts)))
    hot = sent.groupBy("bucket").agg(F.sum("n").alias("windows")).where(F.col("windows") > share)
    hot = hot.select("bucket", F.ceil(F.col("windows") / share).alias("ways"))
    cut = lambda rows, *by, split: rows.repartition(*by).sortWithinPartitions(*by).select("bucket", "blob").mapInArrow(_cut(k, strand, split), schema)
    if hot.limit(1).count():
        dealt = sent.join(F.broadcast(hot), "bucket", "left").select("bucket", "blob", "ways", F.pmod(F.xxhash64("blob"), "ways").alias("way"))
        split = cut(dealt.where("ways is not null"), "bucket", "way", split=True).groupBy(names).agg(F.sum("n").alias("n"))
        out = cut(dealt.where("ways is null"), "bucket", split=False).unionByName(split)
    else:
        out = cut(sent, "bucket", split=False)
    out = out.select(*names, saturate("n").alias("value"))
    return out if keys else unpacked(out, k)
