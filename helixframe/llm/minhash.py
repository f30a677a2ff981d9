"""MinHash near-dedup: documents whose sets of word shingles are similar enough are linked.

1. Each distinct set gets the minima of HASHES universal hash functions a * x + b modulo 2**32 over
   its shingles' hashes.  Minima are cut into bands; sets that agree in a whole band are candidates,
   whose components are clusters.
2. Signatures are verified: of the pairs in a cluster those are discarded whose minima, as bytes, agree
   more rarely than those of linked sets do but once in 10**9 times (see least_agreement).
3. What is left is confirmed on the full sets.
4. The links' components come from alternating large-star and small-star steps.

Clusters are compared by blocks (see simjoin.py), so that no group of copies meets in one task.  A
pair at the threshold shares no band with a probability of (1 - t**rows)**bands, 8e-7 at 0.85, and
ever less above it.  Shingles are told apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import math
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .ngram_join import _digest, _features, _sets, _sizes, _texts
from .shared import Scratch, membership
from .simjoin import PACKED, Layout, candidates, exact_components, layout, linked, packed
from .skew import alternating_stars, hot_from, looked_up

U64, U32 = np.uint64, np.uint32
ROWS, BANDS = 8, 44
HASHES = ROWS * BANDS
AGAIN = (12, 90)  # rows and bands of clusters too large for a task: 1e-6 at 0.85
TOGETHER = 1 << 16  # shingles whose minima are taken at once

_rng = np.random.default_rng(13)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.int64).astype(U32) * U32(2) + U32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.int64).astype(U32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each hash function (a row) over each set (a column)."""
    first = np.concatenate([[0], np.cumsum([len(u) for u in sets])[:-1]])
    x = (np.concatenate(sets) >> U64(32)).astype(U32)
    out, moved = np.empty((HASHES, len(sets)), U32), np.empty_like(x)
    for i in range(HASHES):
        np.multiply(x, _A[i], out=moved)
        moved += _B[i]
        out[i] = np.minimum.reduceat(moved, first)
    return out


def least_agreement(num: int, den: int, risk: float = 1e-9) -> int:
    """The most agreeing minima that linked sets miss only with the given risk, by the binomial distribution at the threshold."""
    p, total = num / den, 0.0
    for k in range(HASHES + 1):
        total += math.exp(math.lgamma(HASHES + 1) - math.lgamma(k + 1) - math.lgamma(HASHES - k + 1) + k * math.log(p) + (HASHES - k) * math.log(1 - p)) if 0 < p < 1 else float(k == HASHES)
        if total > risk:
            return k
    return HASHES


def _few(num: int, den: int) -> int:
    """Sets under this size are linked with equal ones only."""
    return next(s for s in range(1, 1 << 40) if num * (s + 1) <= den * s) if num < den else 1 << 40


def _bands(low: np.ndarray, rows: int, bands: int, salt: int = 0) -> np.ndarray:
    """Signatures (bands x sets) of minima; the rows of a band follow each other."""
    s = np.repeat(T.mix(np.arange(1, bands + 1, dtype=U64) + U64(4096 * salt))[:, None], low.shape[1], 1)
    for r in range(rows):
        s = T.mix(s + low[r::rows][:bands].astype(U64))
    return s


def _banded(k: int, few: int, how: Layout):
    """The signatures of each set of a task, once though many rows have it."""

    def found(batches):
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        names, size, n = [], 0, 0

        def out():
            s = _bands(minima(held), ROWS, BANDS)
            return s.T.ravel(), np.repeat(np.arange(n, n + len(held)), BANDS), np.array(names, np.int64)

        for batch in batches:
            for _, u in _sets(batch, k):
                if len(u) < few or (d := _digest(u)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(d)
                held.append(u)
                names.append(d)
                size += len(u)
                if size > TOGETHER:
                    yield out()
                    n += len(held)
                    held.clear()
                    names.clear()
                    size = 0
        if held:
            yield out()

    return lambda batches: packed(found(batches), how, 1)


def agreeing(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which columns of bytes of a and b agree in at least so many rows."""
    count = np.zeros((a.shape[1], b.shape[1]), np.int16)
    for x, y in zip(a, b, strict=True):
        count += x[:, None] == y[None, :]
    return count >= least


def verified(sets: list[np.ndarray], num: int, den: int, others: list[np.ndarray] | None = None) -> np.ndarray:
    """simjoin.linked() for the sets that have a partner by signature."""
    low = (minima(sets) & U32(255)).astype(np.uint8)
    low2 = low if others is None else (minima(others) & U32(255)).astype(np.uint8)
    open_ = agreeing(low, low2, least_agreement(num, den))
    if others is None:
        np.fill_diagonal(open_, False)
    done = np.zeros(open_.shape, bool)
    x, y = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if len(x):
        done[np.ix_(x, y)] = linked([sets[i] for i in x], num, den, None if others is None else [others[i] for i in y])
    return done & open_


def _banded_again(k: int, how: Layout, turn: int):
    """Signatures of rows (cluster, id, feats) from other bands of more minima; only sets of one cluster may meet."""
    rows, bands = AGAIN
    rng, features = np.random.default_rng(turn), _features(k)
    drawn = np.concatenate([rng.choice(HASHES, rows, replace=False) for _ in range(bands)])

    def found(batches):
        n = 0
        for batch in batches:
            for cluster, i, blob in zip(*(batch.column(c).to_pylist() for c in ("cluster", "id", "feats")), strict=True):
                s = _bands(minima([features(blob)])[drawn], rows, bands, turn + 1)[:, 0]
                yield T.mix(s ^ T.mix(np.array([cluster], np.int64).view(U64))), np.full(len(s), n), np.array([[i, cluster]], np.int64)
                n += 1

    return lambda batches: packed(found(batches), how, 1)


def minhash_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block: int = 2048) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text, ...).

    Two documents are linked when den * overlap >= num * union of their sets of n-word shingles
    (words without case in ASCII); component_id is the smallest doc_id that links reach.  A text of
    fewer than n words has one shingle, its whole sequence.  Without words (null and blank texts too)
    the set is empty: n_shingles is 0 and component_id the doc_id itself.  A row without doc_id is
    returned with a null component_id and isn't linked.  Repeated rows are linked with each other and
    all returned.  A long text's set is held whole by one task, at some 20 bytes a word.  Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    some = all_docs.where("doc_id is not null")
    sizes = scratch.table(all_docs.mapInArrow(_sizes(n), "doc_id long, hash long, n long, d1 long, d2 long"), "sizes")
    # the least document of each set, and which of its texts, should its id be given to several
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.min("n").alias("size"), F.count(F.lit(1)).alias("n"))
    classes = scratch.table(classes.select("d1", "d2", F.col("first.doc_id").alias("doc"), F.col("first.hash").alias("hash"), "size", "n"), "classes")
    few = _few(num, den)
    held, rows = classes.agg(F.count_if(F.col("size") >= few), F.sum("n")).first()
    nodes, names = candidates(scratch, some.mapInArrow(_banded(n, few, layout(BANDS * held)), PACKED), 1)
    # a set that several tasks have read is several nodes of one cluster: one of them stands for it
    members = nodes.withColumnRenamed("node", "of").join(names, "of").groupBy(F.col("root").alias("cluster"), F.col("b").alias("d1"), F.col("c").alias("d2")).agg(F.min("of").alias("id"))
    members = scratch.table(members.join(classes.drop("n"), ["d1", "d2"]), "members")
    scratch.drop(names)
    scratch.drop(nodes)
    counted = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.table(looked_up(members, ["cluster"], counted, hot_from(held)), "members")

    def ship(part: DataFrame) -> DataFrame:
        bitmap = spark.sparkContext.broadcast(membership(part, "doc"))
        texts = some.select(F.col("doc_id").alias("id"), "text", "hash").mapInArrow(_texts(bitmap), "doc long, hash long, feats binary")
        return texts.join(part, ["doc", "hash"])

    def refine(items: DataFrame, turn: int) -> DataFrame:
        how = layout(AGAIN[1] * held)
        again, of = candidates(scratch, items.select("cluster", "id", "feats").mapInArrow(_banded_again(n, how, turn), PACKED), 1)
        return again.join(of, again["node"] == of["of"]).select(F.col("b").alias("id"), F.col("root").alias("cluster")).distinct()

    links = exact_components(scratch, members.withColumnRenamed("size", "n"), ship, num, den, block, _features(n), refine, compare=verified)
    found = alternating_stars(scratch, links.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    found = scratch.table(found.join(members.select("id", "doc", "d1", "d2"), "id"), "found")
    least = found.groupBy("root").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"))
    least = looked_up(found, ["root"], least, hot_from(held)).select("d1", "d2", "least")
    roots = classes.join(least, ["d1", "d2"], "left").select("d1", "d2", "n", F.coalesce("least", "doc").alias("component_id"))
    sizes = sizes.withColumnRenamed("n", "n_shingles")
    linked = looked_up(sizes.where("n_shingles > 0 and doc_id is not null"), ["d1", "d2"], roots, hot_from(rows or 0))
    alone = sizes.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_first_of_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those whose component (see minhash_components) has a smaller doc_id; all columns stay.

    Rows without doc_id and rows without words stay, as do repeated rows of the doc_id that stays.
    An empty table stays empty.
    """
    gone = minhash_components(docs, **options).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
