"""Substring dedup: windows of k words that an earlier document has, found through super-k-mers.

Every window of k words has a minimiser: the least hash among the m-word grams in it.  Consecutive
windows of one document with the same minimiser form a super-k-mer, a run of words that travels as
one packed string to the bucket of its minimiser.  Equal windows have equal minimisers, so a bucket
sees all copies of its windows: there they are sorted and counted exactly, as strings.

Two things keep the volume down without losing a window.  Minimisers are counted first, and only
runs whose minimiser occurs in two documents travel.  Equal runs are one: a run is sent once a
batch, with the least document that has it, and the answer goes back to its occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import Scratch, maybe_in, membership

U64 = np.uint64
GRAM = 8  # words whose hashes compete to be the minimiser
RUN = 1024  # windows in a run at most
CROWD = 4096  # runs in a bucket beyond which its windows are dealt out one by one


def runs(h: np.ndarray, k: int, m: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end and minimiser of the runs of windows over the word hashes h."""
    n = len(h) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64)
    m = min(m, k)
    least = T.shingles(h, m)
    span, width = k - m + 1, 1  # the least of span grams, by doubling
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    new = np.concatenate([[True], least[1:] != least[:-1]])
    cut = np.flatnonzero(new)
    if (np.diff(np.append(cut, n)) > RUN).any():  # repeated words have one minimiser throughout
        at = np.arange(n) - np.repeat(cut, np.diff(np.append(cut, n)))
        cut = np.flatnonzero(at % RUN == 0)
    return cut, np.append(cut[1:], n), least[cut]


def _rows(batch: pa.RecordBatch):
    """(row, bytes, word starts, word ends, word hashes) of each row."""
    data, off = T.buffers(batch.column("text"))
    for i, j in T.groups(off):
        w = T.words(data, off, i, j)
        for r in range(i, j):
            a, b = w.first[r - i], w.first[r - i + 1]
            yield r, data, w.starts[a:b], w.ends[a:b], w.hashes[a:b]


def _minimisers(k: int):
    """(minimiser, low, high): the least and greatest document of a batch that has it."""

    def f(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            x, d = [], []
            for r, _, _, _, h in _rows(batch):
                u = np.unique(runs(h, k)[2])
                x.append(u)
                d.append(np.full(len(u), ids[r]))
            if not x:
                continue
            x, d = np.concatenate(x), np.concatenate(d)
            if not len(x):
                continue
            order = np.lexsort((d, x))
            x, d = x[order], d[order]
            new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            yield T.rows(minimiser=T.signed(x[new]), low=d[new], high=d[np.append(new[1:], len(x)) - 1])

    return f


def _pack(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    if ends[-1] - starts[0] == (ends - starts).sum() + len(starts) - 1:
        return data[starts[0] : ends[-1]].tobytes().translate(_SPACES)
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


_SPACES = bytes(32 if x in (9, 10, 11, 12, 13) else x for x in range(256))

_RUN = "kind int, run binary, minimiser long, words binary, doc_id long, at int"


def _travelling(k: int, bitmap):
    """kind 0: a run and the least document of the batch that has it; kind 1: where a run occurs."""

    def f(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            first: dict[bytes, list] = {}
            name, doc, at = [], [], []
            for r, data, s, e, h in _rows(batch):
                lo, hi, x = runs(h, k)
                if not len(x):
                    continue
                for q in np.flatnonzero(maybe_in(bitmap.value, T.signed(x))).tolist():
                    a, b = int(lo[q]), int(hi[q])
                    packed = _pack(data, s[a : b + k - 1], e[a : b + k - 1])
                    key = hashlib.blake2b(packed, digest_size=16).digest()
                    if key not in first:
                        first[key] = [int(T.signed(x)[q]), packed, int(ids[r])]
                    elif ids[r] < first[key][2]:
                        first[key][2] = int(ids[r])
                    name.append(key)
                    doc.append(int(ids[r]))
                    at.append(a)
            n, o = len(first), len(name)
            if n:
                values = list(first.values())
                yield T.rows(
                    kind=pa.array([0] * n + [1] * o, pa.int32()),
                    run=pa.array([*first, *name], pa.binary()),
                    minimiser=pa.array([v[0] for v in values] + [None] * o, pa.int64()),
                    words=pa.array([v[1] for v in values] + [None] * o, pa.binary()),
                    doc_id=pa.array([v[2] for v in values] + doc, pa.int64()),
                    at=pa.array([None] * n + at, pa.int32()),
                )

    return f


def windows(packed: bytes, k: int) -> list[bytes]:
    cut = [-1, *np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist(), len(packed)]
    return [packed[cut[i] + 1 : cut[i + k]] for i in range(len(cut) - k)]


def _counted(k: int):
    """For each run of a bucket, the least document of each of its windows; rows come sorted by minimiser."""

    def solve(bucket):
        least: dict[bytes, int] = {}
        cut = [(run, doc, windows(words, k)) for run, words, doc in bucket]
        for _, doc, found in cut:
            for w in found:
                if doc < least.get(w, doc + 1):
                    least[w] = doc
        return [(run, np.array([least[w] for w in found], np.int64).tobytes()) for run, _, found in cut]

    def table(out):
        return T.rows(run=pa.array([x for x, _ in out], pa.binary()), least=pa.array([x for _, x in out], pa.binary()))

    def f(batches):
        key, bucket, out = None, [], []
        for batch in batches:
            for x, *row in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "run", "words", "doc_id")), strict=True):
                if x != key:
                    out += solve(bucket)
                    key, bucket = x, []
                    if len(out) > 5000:
                        yield table(out)
                        out = []
                bucket.append(row)
        out += solve(bucket)
        if out:
            yield table(out)

    return f


def _dealt(k: int):
    def f(batches):
        for batch in batches:
            for run, words, doc in zip(*(batch.column(c).to_pylist() for c in ("run", "words", "doc_id")), strict=True):
                found = windows(words, k)
                yield T.rows(run=pa.array([run] * len(found), pa.binary()), at=pa.array(range(len(found)), pa.int32()), window=pa.array(found, pa.binary()), doc_id=pa.array([doc] * len(found), pa.int64()))

    return f


def _packed_longs(column: str):
    """Sorted (at, least) pairs as one binary value of little-endian longs."""

    def f(batches):
        for batch in batches:
            yield T.rows(run=batch.column("run"), least=pa.array([np.array([x["least"] for x in v], np.int64).tobytes() for v in batch.column(column).to_pylist()], pa.binary()))

    return f


def _spans(k: int):
    """Spans of words (start, end) that a document loses through one occurrence of a run."""

    def f(batches):
        for batch in batches:
            doc, lo, hi = [], [], []
            for d, at, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "least")), strict=True):
                gone = np.flatnonzero(np.frombuffer(blob, np.int64) < d)
                if len(gone):
                    cut = np.flatnonzero(np.diff(gone) > 1)
                    for a, b in zip(gone[np.append(0, cut + 1)], gone[np.append(cut, len(gone) - 1)], strict=True):
                        doc.append(d)
                        lo.append(at + int(a))
                        hi.append(at + int(b) + k)
            if doc:
                yield T.rows(doc_id=np.array(doc, np.int64), lo=np.array(lo, np.int64), hi=np.array(hi, np.int64))

    return f


def _kept(batches):
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        n, gone, text = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [""] * len(batch)
        for r, data, s, e, _ in _rows(batch):
            n[r] = len(s)
            keep = np.ones(len(s), bool)
            for x in spans[r] or ():
                keep[x["lo"] : x["hi"]] = False
            gone[r] = len(s) - keep.sum()
            if keep.any():
                text[r] = _pack(data, s[keep], e[keep]).decode()
        yield T.rows(doc_id=batch.column("doc_id"), n_words=n, n_removed=gone, kept_text=pa.array(text, pa.string()))


def remove_repeated_windows(docs: DataFrame, k: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs (doc_id, text, ...).

    A word goes when a window of k words over it also starts in a document with a smaller doc_id;
    windows are judged on the input.  kept_text has the other words, joined by one space.  Repeats
    within one document stay, and so do texts shorter than k words.  A null text has no words.  A
    row without doc_id is returned unchanged and takes nothing from others.  Repeated rows have one
    doc_id, so they take nothing from each other.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = all_docs.where("doc_id is not null")
    seen = some.mapInArrow(_minimisers(k), "minimiser long, low long, high long")
    seen = seen.groupBy("minimiser").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("minimiser")
    bitmap = spark.sparkContext.broadcast(membership(seen, "minimiser"))
    found = scratch.table(some.mapInArrow(_travelling(k, bitmap), _RUN), "runs")
    once = found.where("kind = 0").groupBy("run").agg(F.first("minimiser").alias("minimiser"), F.first("words").alias("words"), F.min("doc_id").alias("doc_id"))
    once = scratch.table(once, "once")
    crowds = scratch.table(once.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("minimiser"), "crowds")
    least = once.join(crowds, "minimiser", "left_anti").repartition("minimiser").sortWithinPartitions("minimiser").select("minimiser", "run", "words", "doc_id").mapInArrow(_counted(k), "run binary, least binary")
    if crowds.limit(1).count():
        dealt = scratch.table(once.join(crowds, "minimiser", "left_semi").mapInArrow(_dealt(k), "run binary, at int, window binary, doc_id long"), "dealt")
        first = dealt.groupBy("window").agg(F.min("doc_id").alias("least"))
        back = dealt.join(first, "window").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("found"))
        least = least.unionByName(back.mapInArrow(_packed_longs("found"), "run binary, least binary"))
    spans = found.where("kind = 1").select("run", "doc_id", "at").join(least, "run").select("doc_id", "at", "least").mapInArrow(_spans(k), "doc_id long, lo long, hi long")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = scratch.table(spans, "spans")
    return all_docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")
