"""N-gram Jaccard join: documents linked when their sets of word shingles are similar enough.

The join is the product of the sparse document-by-shingle matrix with its transpose, blocked twice.

Rows: documents with the same set are one row.  Two sets of Jaccard similarity t or more differ in
at most H = (1-t)/t * A shingles, where A bounds the smaller size.  So when the columns (shingles,
by hash) are dealt into more than H blocks, some block of columns is the same in both.  Sizes are cut
into classes, and each set sends one signature a column block, for its own class and the one below;
sets that share no column block are below the bound that their sizes give, and their product is
never formed.  A set is a candidate in each of its two classes by itself, so that clusters of
candidates hold sizes of two classes only; those without a set whose own class it is are left out,
as the class above has the same links.  Shingles that many documents share are left out of the signatures, which keeps the
bound, so that a common passage alone brings no crowd together; sets that leave too few send their
rarest shingles besides.  Which shingles are common is told by a counter for each
of 2**COUNTERS hash values, over all documents; it decides how much is compared, never what is linked.

Products: the overlaps of each cluster of rows that remain are accumulated over blocks of columns,
and pairs are discarded as soon as they can't reach the bound (see simjoin.py).

Clusters too large for a task are cut by the same signatures over other column blocks, dealt anew:
sets that only met by chance or through a shared passage rarely meet again, sets that are linked always do.

Shingles are told apart by 64-bit hashes, sets by 128 bits.  Candidates travel as compressed texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .packing import squeeze, unsqueeze
from .shared import Scratch, connected_components, maybe_in, membership
from .simjoin import PACKED, Layout, candidates, exact_components, layout, packed

U64 = np.uint64
COUNTERS = 22
PARTS = 1024  # in which the counters are added up
COMMON = (32, 4.0)  # a shingle is common from so many documents, and so many times the mean of all counters


def size_classes(num: int, den: int, most: int = 1 << 34) -> np.ndarray:
    """First sizes of the classes: sets whose sizes allow a link lie in one class or in two neighbours."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * den // num + 1))
    return np.array(out, np.int64)


def slack(h: int) -> int:
    """Column blocks beyond the bound, so that a few empty ones don't matter."""
    return 2 + h // 32


def signatures(u: np.ndarray, classes: np.ndarray, num: int, den: int, common: np.ndarray | None = None, deal: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sorted set u, and for each whether it is for the class below the set's own.

    common: bits of the counters' slots that are common.  Two sets that may be linked agree in more
    column blocks than ``slack``.  So if one of them has at most that many empty ones, they agree in
    a block that isn't empty.  A set with more also sends the shingles that come first by (common,
    hash), one more than may be missing in a set it is linked with: two such sets share one of them.
    Another ``deal`` deals the columns into other blocks.
    """
    out, below = [], []
    g = int(np.searchsorted(classes, len(u), "right")) - 1
    is_common = np.zeros(len(u), bool) if common is None else maybe_in(common, _slot(u))
    if deal:
        u = T.mix(u + U64(T.MASK & (deal * 0xC2B2AE3D27D4EB4F)))
        order = np.argsort(u)
        u, is_common = u[order], is_common[order]
    rare = u[~is_common]
    high, hashed = rare >> U64(32), T.mix(rare + U64(0x632BE59BD9B4E019))
    for group in (g, g - 1):
        h = (den - num) * int(classes[group + 1] - 1) // num if group >= 0 else 0
        if h < 1:
            continue  # sets of these sizes are linked only if they are equal
        spare = slack(h)
        k = h + 1 + spare
        salt = U64(T.MASK & (group * 0xA24BAED4963EE407))
        cut = np.zeros(0, np.int64)
        if len(rare):
            block = (high * U64(k) >> U64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            out.append(T.mix(np.add.reduceat(hashed, cut) + block[cut].astype(U64) * U64(0x9FB21C651E98DF25) + salt))
            below.append(np.full(len(cut), group < g))
        if k - len(cut) > spare:
            first = len(u) - -(-num * len(u) // den) + 1
            out.append(T.mix(np.concatenate([rare, u[is_common]])[:first] + U64(0x1B873593) + salt))
            below.append(np.full(len(out[-1]), group < g))
    if not out:
        return np.zeros(0, U64), np.zeros(0, bool)
    return np.concatenate(out), np.concatenate(below)


def _slot(u: np.ndarray) -> np.ndarray:
    return (u >> U64(20)).astype(np.int64) & ((1 << COUNTERS) - 1)


def _counted(k: int):
    """The counters of one task, in compressed parts."""

    def f(batches):
        counts, seen = np.zeros(1 << COUNTERS, np.uint32), set()
        for batch in batches:
            for _, u in _sets(batch, k):
                d = _digest(u)[0]
                if d not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(d)
                    np.add.at(counts, _slot(u), 1)
        if seen:
            parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(PARTS, -1)]
            yield T.rows(part=np.arange(PARTS), counts=pa.array(parts, pa.binary()))

    return f


def _added(batches):
    """Sums of the parts of all tasks; rows come sorted by part."""
    part = total = None

    def out():
        return T.rows(part=[part], total=[int(total.sum())], counts=pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()))

    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            x = np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
            if p != part:
                if part is not None:
                    yield out()
                part, total = p, np.zeros(len(x), np.int64)
            total += x
    if part is not None:
        yield out()


def _bits(least: float):
    """Which of a part's counters are at least so high, eight in a byte."""

    def f(batches):
        for batch in batches:
            bits = [np.packbits(np.frombuffer(zlib.decompress(x.as_py()), np.int64) >= least, bitorder="little").tobytes() for x in batch.column("counts")]
            yield T.rows(part=batch.column("part"), bits=pa.array(bits, pa.binary()))

    return f


def common_shingles(scratch: Scratch, docs: DataFrame, k: int) -> np.ndarray:
    """A bitmap of the slots whose counters say that their shingles are common; its size is fixed, and the counters stay with the tasks."""
    counted = docs.mapInArrow(_counted(k), "part long, counts binary").repartition("part").sortWithinPartitions("part").mapInArrow(_added, "part long, total long, counts binary")
    counted = scratch.table(counted, "counters")
    mean = (counted.agg(F.sum("total")).first()[0] or 0) / (1 << COUNTERS)
    out = np.zeros((PARTS, (1 << COUNTERS) // PARTS // 8), np.uint8)
    for r in counted.mapInArrow(_bits(max(COMMON[0], COMMON[1] * mean)), "part long, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel().view(np.uint32)


def _sets(batch: pa.RecordBatch, k: int):
    """(row, sorted set of shingles) for each row with words."""
    data, off = T.buffers(batch.column("text"))
    for i, j in T.groups(off):
        w = T.words(data, off, i, j, values=T.LOWER_VALUES)
        for r in range(i, j):
            h = w.hashes[w.first[r - i] : w.first[r - i + 1]]
            if len(h):
                yield r, np.unique(T.shingles(h, k))


def _digest(u: np.ndarray) -> tuple[int, int]:
    """A set's hash, two longs."""
    x = T.mix(u)
    y = np.array([x.sum(dtype=U64) + U64(len(u)), T.mix(x + U64(0x2545F4914F6CDD1D)).sum(dtype=U64)], U64)
    a, b = T.signed(T.mix(y)).tolist()
    return a, b


def _sizes(k: int):
    def f(batches):
        for batch in batches:
            size, digest = np.zeros(len(batch), np.int64), np.zeros((len(batch), 2), np.int64)
            for r, u in _sets(batch, k):
                size[r], digest[r] = len(u), _digest(u)
            yield T.rows(doc_id=batch.column("doc_id"), hash=batch.column("hash"), n=size, d1=digest[:, 0].copy(), d2=digest[:, 1].copy())

    return f


def _signed(k: int, num: int, den: int, common, how: Layout):
    """The signatures of each set of a task, once though many rows have it."""
    classes = size_classes(num, den)

    def found(batches):
        seen: set[tuple[int, int]] = set()
        s, x, names, size, n = [], [], [], 0, 0
        for batch in batches:
            for _, u in _sets(batch, k):
                d = _digest(u)
                if d in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(d)
                sig, below = signatures(u, classes, num, den, common.value)
                if len(sig):
                    s.append(sig)
                    x.append(2 * n + below.astype(np.int64))
                    names.append(d)
                    size, n = size + len(sig), n + 1
                if size > 500_000:
                    yield np.concatenate(s), np.concatenate(x), np.array(names, np.int64)
                    s, x, names, size = [], [], [], 0
        if names:
            yield np.concatenate(s), np.concatenate(x), np.array(names, np.int64)

    return lambda batches: packed(found(batches), how)


def _texts(bitmap):
    """Compressed texts of the documents that may be in the bitmap."""

    def f(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            wanted = np.flatnonzero(maybe_in(bitmap.value, ids))
            if len(wanted):
                data, off = T.buffers(batch.column("text"))
                feats = [squeeze(data[off[r] : off[r + 1]].tobytes()) for r in wanted.tolist()]
                yield T.rows(doc=ids[wanted], hash=batch.column("hash").to_numpy()[wanted], feats=pa.array(feats, pa.binary()))

    return f


def _features(k: int):
    def f(blob: bytes) -> np.ndarray:
        for _, u in _sets(pa.RecordBatch.from_arrays([pa.array([unsqueeze(blob)], pa.binary())], names=["text"]), k):
            return u
        return np.zeros(0, U64)

    return f


def _dealt_anew(k: int, num: int, den: int, common, how: Layout, deal: int):
    """Signatures of rows (cluster, id, feats) over other column blocks; only sets of one cluster may meet."""
    classes, features = size_classes(num, den), _features(k)

    def found(batches):
        n = 0
        for batch in batches:
            for cluster, i, blob in zip(*(batch.column(c).to_pylist() for c in ("cluster", "id", "feats")), strict=True):
                sig, below = signatures(features(blob), classes, num, den, common.value, deal)
                sig = sig[below == bool(i & 1)]
                yield T.mix(sig ^ T.mix(np.array([cluster], np.int64).view(U64))), np.full(len(sig), 2 * n), np.array([[i, cluster]], np.int64)
                n += 1

    return lambda batches: packed(found(batches), how)


def _with_own_class(members: DataFrame) -> DataFrame:
    """Members (cluster, id, ...) of the clusters in which some set stands in its own class; the others' links are seen in the class above."""
    return members.join(members.where("id & 1 = 0").select("cluster").distinct(), "cluster", "left_semi")


def ngram_jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block: int = 2048) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text, ...).

    Two documents are linked when den * overlap >= num * union of their sets of n-word shingles;
    component_id is the smallest doc_id that links reach.  A text of fewer than n words has one
    shingle, its whole sequence.  Without words (null and blank texts too) the set is empty:
    n_shingles is 0 and component_id the doc_id itself.  A row without doc_id is returned with a
    null component_id and isn't linked.  Repeated rows are linked with each other and all returned.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    some = all_docs.where("doc_id is not null")
    sizes = scratch.table(all_docs.mapInArrow(_sizes(n), "doc_id long, hash long, n long, d1 long, d2 long"), "sizes")
    # the least document of each set, and which of its texts, should its id be given to several
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.min("n").alias("n"))
    classes = scratch.table(classes.select("d1", "d2", F.col("first.doc_id").alias("doc"), F.col("first.hash").alias("hash"), "n"), "classes")
    features = classes.agg(F.sum("n")).first()[0] or 0
    how = layout(features * 2.3 * (den - num) / num)
    common = spark.sparkContext.broadcast(common_shingles(scratch, some, n))
    nodes, names = candidates(scratch, some.mapInArrow(_signed(n, num, den, common, how), PACKED))
    # a set that several tasks have read is several nodes of one cluster: one of them stands for it
    members = nodes.select(F.col("root").alias("cluster"), F.expr("node & ~1L").alias("of"), F.expr("node & 1").alias("below")).join(names, "of")
    members = members.groupBy("cluster", "below", F.col("b").alias("d1"), F.col("c").alias("d2")).agg(F.min("of").alias("of"))
    members = _with_own_class(members.withColumn("id", F.col("of") + F.col("below")))
    members = scratch.table(members.join(classes, ["d1", "d2"]).select("cluster", "id", "doc", "hash", "d1", "d2", "n"), "members")
    scratch.drop(names)
    scratch.drop(nodes)

    def ship(part: DataFrame) -> DataFrame:
        bitmap = spark.sparkContext.broadcast(membership(part, "doc"))
        texts = some.select(F.col("doc_id").alias("id"), "text", "hash").mapInArrow(_texts(bitmap), "doc long, hash long, feats binary")
        return texts.join(part, ["doc", "hash"])

    def refine(items: DataFrame, k: int) -> DataFrame:
        again, of = candidates(scratch, items.select("cluster", "id", "feats").mapInArrow(_dealt_anew(n, num, den, common, how, k + 1), PACKED))
        found = again.join(of, again["node"] == of["of"]).select(F.col("b").alias("id"), F.col("root").alias("cluster")).distinct()
        return _with_own_class(found)

    found = exact_components(scratch, members, ship, num, den, block, _features(n), refine)
    found = connected_components(scratch, found.select(F.expr("id & ~1L").alias("a"), F.expr("root & ~1L").alias("b")))
    of = members.select(F.expr("id & ~1L").alias("node"), "doc", "d1", "d2").distinct()
    found = scratch.table(found.join(of, "node"), "found")
    least = found.groupBy("root").agg(F.min("doc").alias("least"))
    roots = classes.join(found.join(least, "root").select("d1", "d2", "least"), ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "doc").alias("component_id"))
    out = sizes.join(roots, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id; all columns stay.

    Rows without doc_id stay; of repeated rows one stays.
    """
    found = ngram_jaccard_components(docs, **options)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
