"""Exact similarity components over sets of 64-bit features.

Signatures bring similar sets together; every list of sets that share one becomes a star of
candidate links, and the components of these stars are candidate clusters.  Within a cluster the
overlaps are computed exactly as a blocked product of the sparse set-by-feature matrix.

Signatures travel packed: a task numbers its sets, sorts its signatures, and sends each bucket (a
range of signatures) one blob of differences and numbers, five bytes or so for a signature.  What the
numbers stand for travels once a set.  Where sketches travel along, links are contracted and names stay
packed until it is known which are wanted (see _meet_alike).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import by_byte, pack, squeeze, unpack, unsqueeze
from .shared import Scratch, bitmap_of, connected_components, least_reached, maybe_in
from .text import mix, rows

U64 = np.uint64
BLOCK = 2048  # sets that are compared in one task
FEATURES = 1 << 21  # and how many features they have in all, about
COLUMNS = 2048  # features multiplied at once
HELD = 2_000_000  # signatures that a task sorts at once
REFINEMENTS = 3

PACKED = "kind int, bucket int, base long, blob binary"
_ENTRIES, _LINKS, _NAMES = 0, 1, 2


@dataclass(frozen=True)
class Layout:
    """Signatures are cut to ``width`` bits, of which the leading ``bits`` name their bucket."""

    bits: int
    width: int


def layout(n: float, spare: int = 20) -> Layout:
    """For about n signatures: some 200,000 in a bucket, and one in 2**spare equal to another by chance.

    A bucket of n beyond 2**37 holds more in proportion.
    """
    size = max(1, int(n)).bit_length()
    return Layout(min(20, max(4, size - 17)), min(63, max(24, size) + spare))


LEADERS = 1 << 13  # of a signature that a node may be compared with by sketches


def alike_nodes(s: np.ndarray, x: np.ndarray, sketch: list[np.ndarray], alike: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of links between nodes x that share a signature and agree in enough bits of their sketches, and which nodes lead; s is sorted.

    sketch: one or more columns of 64 bits.  alike: how many of all bits have to agree, by kind of
    node.  The first node of a signature is compared with all others; those that aren't alike are compared with the first of them, and so on.
    What is left after LEADERS turns is linked without regard to sketches, so that nothing is lost by the limit.
    """
    least = np.array(alike)[x % len(alike)]
    again = s[1:] == s[:-1]
    leads = ~(np.append(again, False) | np.append(False, again)) if len(s) else np.zeros(0, bool)
    rest = np.flatnonzero(~leads)  # most signatures come once
    a, b, first_of = [], [], np.zeros(len(s), np.int64)
    for turn in range(LEADERS):
        if not len(rest):
            break
        new = np.ones(len(rest), bool)
        new[1:] = s[rest[1:]] != s[rest[:-1]]
        head = rest[np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))]
        if not turn:
            first_of[rest] = head
        leads[rest[new]] = True
        differ = sum(np.bitwise_count(w[rest] ^ w[head]).astype(np.int64) for w in sketch)
        same = ~new & (64 * len(sketch) - differ >= least[rest])
        a.append(x[rest[same]])
        b.append(x[head[same]])
        rest = rest[~new & ~same]
    a.append(x[rest])
    b.append(x[first_of[rest]])
    return np.concatenate(a), np.concatenate(b), leads


def _entries(s: np.ndarray, x: np.ndarray, sketch: list[np.ndarray], cut: np.ndarray) -> Iterator[bytes]:
    """A blob for each bucket, which begin at cut: its sketches as they are, but words that are 0 in all, then its signatures and nodes as by pack().

    s: signatures, ascending in each bucket, without the bits that name it.
    """
    gap = np.diff(s, prepend=s[:1])
    gap[cut] = s[cut]
    columns = [by_byte(gap), by_byte(x)]
    used = np.stack([np.bitwise_or.reduceat(w, cut) != 0 for w in sketch]) if len(cut) else np.zeros((len(sketch), 0), bool)
    heads = [bytes([len(c)]) for c in columns]
    for k, (a, b) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(s)], strict=True)):
        words = sum(1 << j for j in range(len(sketch)) if used[j, k])
        plain = b"".join([(b - a).to_bytes(8, "little"), *(y for h, c in zip(heads, columns, strict=True) for y in (h, c[:, a:b].tobytes()))])
        yield b"".join([(b - a).to_bytes(8, "little"), words.to_bytes(8, "little"), *(w[a:b].tobytes() for j, w in enumerate(sketch) if used[j, k]), squeeze(plain)])


def _entries_of(blob: bytes, kinds_of_words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Signatures, nodes and sketches, as _entries() got them."""
    n, words, at, sketch = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little"), 16, []
    for j in range(kinds_of_words):
        if words >> j & 1:
            sketch.append(np.frombuffer(blob, U64, n, at))
            at += 8 * n
        else:
            sketch.append(np.zeros(n, U64))
    s, x = unpack(blob[at:])
    return s, x, sketch


def packed(found: Iterator[tuple[np.ndarray, ...]], how: Layout, kinds_of_nodes: int = 2, alike: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
    """PACKED rows from (signatures, nodes, names[, sketches]) in turn; a sketch (rows of 64 bits) for each signature where there is ``alike`` (see alike_nodes).

    names has a pair of longs for each new set; the task's sets are numbered from 0 as they come, and
    set i has the nodes 2 * i and 2 * i + 1, or as many as there are kinds.  Signatures that one task
    meets again leave it as links.
    """
    part = TaskContext.get().partitionId()
    base, spread, n_sets = part * ((1 << 36) // kinds_of_nodes * kinds_of_nodes), part, 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def out():
        nonlocal spread, n_sets
        s, x = np.concatenate([h[0] for h in held]) >> U64(64 - how.width), np.concatenate([h[1] for h in held])
        names = np.concatenate([h[2] for h in held])
        order = np.argsort(s)
        s, x = s[order], x[order]
        sketch = [np.concatenate(w)[order] for w in zip(*(h[3] for h in held), strict=True)] if alike else []
        if alike:
            link_a, link_b, new = alike_nodes(s, x, sketch, alike)
        else:
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            link_a, link_b = x[~new], x[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))][~new]
        kinds, buckets, bases, blobs = [], [], [], []

        def add(kind, bucket, of, blob):
            kinds.append(kind)
            buckets.append(bucket)
            bases.append(of)
            blobs.append(blob)

        if not new.all():
            link = np.unique((link_a.astype(U64) << U64(32)) | link_b.astype(U64))
            link = link[(link >> U64(32)) != (link & U64(0xFFFFFFFF))]
            for at in range(0, len(link), 500_000):
                some = link[at : at + 500_000]
                add(_LINKS, spread % (1 << how.bits), base, pack(some >> U64(32), some & U64(0xFFFFFFFF)))
                spread += 1
            s, x, sketch = s[new], x[new], [y[new] for y in sketch]
        bucket = (s >> U64(how.width - how.bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        if alike:
            for a, blob in zip(cut, _entries(s & U64((1 << how.width - how.bits) - 1), x, sketch, cut), strict=True):
                add(_ENTRIES, int(bucket[a]), base, blob)
        else:
            for a, b in zip(cut, np.append(cut[1:], len(s)), strict=True):
                add(_ENTRIES, int(bucket[a]), base, pack(s[a:b], x[a:b]))
        for at in range(0, len(names), 500_000):
            add(_NAMES, spread % (1 << how.bits), base + kinds_of_nodes * (n_sets + at), squeeze(names[at : at + 500_000].tobytes()))
            spread += 1
        n_sets += len(names)
        held.clear()
        for at in range(0, len(blobs), 2000):
            cut_ = slice(at, at + 2000)
            yield rows(kind=pa.array(kinds[cut_], pa.int32()), bucket=pa.array(buckets[cut_], pa.int32()), base=pa.array(bases[cut_], pa.int64()), blob=pa.array(blobs[cut_], pa.binary()))

    for some in found:
        held.append(some)
        size += len(some[0])
        if size > HELD:
            yield from out()
            size = 0
    if held:
        yield from out()


MET = "kind int, a long, b long, c long"


def _meet(batches: Iterator[pa.RecordBatch], kinds_of_nodes: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: links of each signature's nodes to the least of them, and the names of nodes."""

    def table(kind, a, b, c=None):
        return rows(kind=pa.array(np.full(len(a), kind, np.int32)), a=a.astype(np.int64), b=b.astype(np.int64), c=np.zeros(len(a), np.int64) if c is None else c.astype(np.int64))

    def links(s, x):
        s, x = np.concatenate(s), np.concatenate(x)
        order = np.argsort(s)
        again = s[order[1:]] == s[order[:-1]]
        order = order[np.append(again, False) | np.append(False, again)]  # most signatures come once
        order = order[np.lexsort((x[order], s[order]))]
        s, x = s[order], x[order]
        again = np.zeros(len(s), bool)
        again[1:] = s[1:] == s[:-1]
        head = x[np.maximum.accumulate(np.where(again, 0, np.arange(len(s))))]
        pair = np.unique(np.stack([x[again], head[again]], 1), axis=0)
        return table(_LINKS, pair[:, 0], pair[:, 1])

    last, s, x = None, [], []
    for batch in batches:
        for kind, bucket, base, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "base", "blob")), strict=True):
            if bucket != last:
                if len(s) > 1:  # within one blob no signature comes twice
                    yield links(s, x)
                last, s, x = bucket, [], []
            if kind == _NAMES:
                names = np.frombuffer(unsqueeze(blob), np.int64).reshape(-1, 2)
                yield table(_NAMES, base + kinds_of_nodes * np.arange(len(names)), names[:, 0], names[:, 1])
                continue
            a, b = unpack(blob)
            if kind == _ENTRIES:
                s.append(a)
                x.append(b.astype(np.int64) + base)
            else:
                yield table(_LINKS, a.astype(np.int64) + base, b.astype(np.int64) + base)
    if len(s) > 1:
        yield links(s, x)


MET_ALIKE = "kind int, base long, blob binary"
CONTRACTED = 1_000_000  # links that are contracted at once
SLOTS = 512  # into which links are dealt by their greater nodes


def _contracted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars around the least node that each node reaches; nodes ascend."""
    node, root = least_reached(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
    other = node != root
    return node[other], root[other]


def _meet_alike(batches: Iterator[pa.RecordBatch], kinds_of_nodes: int, alike: tuple[int, ...], words: int) -> Iterator[pa.RecordBatch]:
    """As _meet() for entries with sketches; links leave a task contracted and packed by slots (as base), and names as they came."""

    def row(kind, base, blob):
        return rows(kind=pa.array([kind], pa.int32()), base=pa.array([base], pa.int64()), blob=pa.array([blob], pa.binary()))

    def links(s, x, sketch):
        s, x = np.concatenate(s), np.concatenate(x)
        order = np.argsort(s)
        again = s[order[1:]] == s[order[:-1]]
        order = order[np.append(again, False) | np.append(False, again)]
        order = order[np.lexsort((x[order], s[order]))]
        a, b, _ = alike_nodes(s[order], x[order], [np.concatenate(w)[order] for w in zip(*sketch, strict=True)], alike)
        return a, b

    def out(held):
        a, b = _contracted(held)
        if not len(a):
            return
        slot = (mix(a.astype(U64)) % U64(SLOTS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        a, b, slot = a[order].astype(U64), b[order].astype(U64), slot[order]
        cut = np.flatnonzero(np.diff(slot, prepend=-1))
        blobs = [pack(a[lo:hi], b[lo:hi]) for lo, hi in zip(cut, np.append(cut[1:], len(a)), strict=True)]
        yield rows(kind=pa.array(np.full(len(cut), _LINKS, np.int32)), base=slot[cut], blob=pa.array(blobs, pa.binary()))

    last, s, x, sketch, held, size = None, [], [], [], [], 0
    for batch in batches:
        for kind, bucket, base, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "base", "blob")), strict=True):
            if bucket != last:
                if s:
                    held.append(links(s, x, sketch))
                    size += len(held[-1][0])
                last, s, x, sketch = bucket, [], [], []
            if kind == _ENTRIES:
                a, b, more = _entries_of(blob, words)
                sketch.append(more)
                s.append(a)
                x.append(b.astype(np.int64) + base)
            elif kind == _NAMES:
                yield row(_NAMES, base, blob)
            else:
                a, b = unpack(blob)
                held.append((a.astype(np.int64) + base, b.astype(np.int64) + base))
                size += len(a)
            if size > CONTRACTED:
                yield from out(held)
                held, size = [], 0
    if s:
        held.append(links(s, x, sketch))
    if held:
        yield from out(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed links, sorted by slot, as (a, b), each once though many tasks have found it."""

    def once(held):
        a, b = (np.concatenate(y) for y in zip(*held, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[new], b[new]

    last, held, size, most = None, [], 0, CONTRACTED
    for batch in batches:
        for slot, blob in zip(batch.column("base").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if slot != last:
                if held:
                    yield rows(**dict(zip("ab", once(held), strict=True)))
                last, held, size, most = slot, [], 0, CONTRACTED
            held.append(tuple(y.astype(np.int64) for y in unpack(blob)))
            size += len(held[-1][0])
            if size > most:
                held = [once(held)]
                size = len(held[0][0])
                most = max(CONTRACTED, 2 * size)
    if held:
        yield rows(**dict(zip("ab", once(held), strict=True)))


def _of(nodes: np.ndarray, kinds_of_nodes: int) -> np.ndarray:
    """A scrambled number of the set that has each node."""
    return mix((nodes // kinds_of_nodes).astype(U64)).view(np.int64)


def _named(kinds_of_nodes: int, bitmap):
    """(of, b, c) from packed names, of the sets in the bitmap and few others."""

    def f(batches):
        for batch in batches:
            for base, blob in zip(batch.column("base").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                names = np.frombuffer(unsqueeze(blob), np.int64).reshape(-1, 2)
                of = base + kinds_of_nodes * np.arange(len(names))
                use = maybe_in(bitmap.value, _of(of, kinds_of_nodes))
                yield rows(of=of[use], b=names[use, 0].copy(), c=names[use, 1].copy())

    return f


def candidates(scratch: Scratch, found: DataFrame, kinds_of_nodes: int = 2, alike: tuple[int, ...] = (), words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the candidate components, and (of, b, c) with the names of each set's first node, from PACKED rows.

    alike: as packed() had it, with sketches of so many words; then sets without a component may have no name.
    """
    found = found.repartition("bucket").sortWithinPartitions("bucket")
    if alike:
        met = scratch.table(found.mapInArrow(partial(_meet_alike, kinds_of_nodes=kinds_of_nodes, alike=alike, words=words), MET_ALIKE), "met")
        stars = met.where(F.col("kind") == _LINKS).select("base", "blob").repartition("base").sortWithinPartitions("base").mapInArrow(_stars, "a long, b long")
        nodes = scratch.table(connected_components(scratch, stars, contracted=True), "nodes")
        bitmap = bitmap_of(nodes.select("node"), lambda batches: (_of(batch.column("node").to_numpy(), kinds_of_nodes) for batch in batches), nodes.count())
        bitmap = scratch.spark.sparkContext.broadcast(bitmap)
        return nodes, met.where(F.col("kind") == _NAMES).select("base", "blob").mapInArrow(_named(kinds_of_nodes, bitmap), "of long, b long, c long")
    met = scratch.table(found.mapInArrow(partial(_meet, kinds_of_nodes=kinds_of_nodes), MET), "met")
    nodes = scratch.table(connected_components(scratch, met.where(F.col("kind") == _LINKS).select("a", "b")), "nodes")
    return nodes, met.where(F.col("kind") == _NAMES).select(F.col("a").alias("of"), "b", "c")


def linked(sets: list[np.ndarray], num: int, den: int, others: list[np.ndarray] | None = None) -> np.ndarray:
    """Which pairs of a set and one of the others (or of the same sets) have den * overlap >= num * union, as a table of booleans.

    The set-by-feature matrix is multiplied by the others' transpose over blocks of features, the
    most frequent first.  After each block a pair whose count plus the features that remain is below
    the overlap that the two sizes require is discarded; sets without open pairs leave the product.
    """
    same = others is None
    if same and len(sets) == 2:
        both = np.concatenate(sets)
        both.sort()
        hit = (den + num) * int(np.count_nonzero(both[1:] == both[:-1])) >= num * len(both)
        return np.array([[False, hit], [hit, False]])
    others = sets if same else others
    m, n = len(sets), len(others)
    size = np.array([len(x) for x in sets], np.int32)
    size2 = size if same else np.array([len(x) for x in others], np.int32)
    required = -(-num * np.arange(int(size.max()) + int(size2.max()) + 1) // (den + num)) if m and n else np.zeros(1, np.int64)
    need = required.astype(np.int32)[size[:, None] + size2[None, :]]
    open_ = np.minimum(size[:, None], size2[None, :]) >= need
    if same:
        np.fill_diagonal(open_, False)
    done = np.zeros((m, n), bool)
    if not open_.any():
        return done
    feature, column = np.unique(np.concatenate(sets if same else [*sets, *others]), return_inverse=True)
    split = int(size.sum())
    df = np.bincount(column[:split], minlength=len(feature))
    df2 = df if same else np.bincount(column[split:], minlength=len(feature))
    del feature
    both = df > 1 if same else (df > 0) & (df2 > 0)
    shared = int(both.sum())
    rank = np.full(len(df), shared, np.int32)
    which = np.flatnonzero(both)
    rank[which[np.argsort(-(df + df2)[which], kind="stable")]] = np.arange(shared)
    column = rank[column]

    def by_column(sizes: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[column < shared]
        column = column[column < shared]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    row, column1 = by_column(size, column[:split])
    row2, column2 = (row, column1) if same else by_column(size2, column[split:])
    rest, rest2 = np.bincount(row, minlength=m).astype(np.int32), np.bincount(row2, minlength=n).astype(np.int32)
    count = np.zeros((m, n), np.float32)

    def block(row: np.ndarray, column: np.ndarray, alive: np.ndarray, rest: np.ndarray, at: int) -> np.ndarray:
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        where = np.full(len(rest), -1)
        where[alive] = np.arange(len(alive))
        r, c = where[row[lo:hi]], column[lo:hi] - at
        x = np.zeros((len(alive), min(COLUMNS, shared - at)), np.float32)
        x[r[r >= 0], c[r >= 0]] = 1
        rest -= np.bincount(row[lo:hi], minlength=len(rest)).astype(np.int32)
        return x

    alive, alive2 = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    for at in range(0, shared, COLUMNS):
        x = block(row, column1, alive, rest, at)
        y = x if same else block(row2, column2, alive2, rest2, at)
        left = rest if same else rest2
        cells = np.ix_(alive, alive2)
        now = x @ y.T
        now += count[cells]
        count[cells] = now
        wanted, still = need[cells], open_[cells]
        reached = now >= wanted
        done[cells] |= still & reached
        wanted -= np.minimum(rest[alive][:, None], left[alive2][None, :])
        still &= ~reached & (now >= wanted)
        open_[cells] = still
        alive, alive2 = alive[still.any(1)], alive2[still.any(0)]
        if not len(alive):
            break
    return done


def components(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches."""
    m = len(adjacent)
    if m == 2:
        return np.array([0, 0 if adjacent[0, 1] else 1])
    out = np.full(m, -1)
    for i in range(m):
        if out[i] < 0:
            out[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(adjacent[front].any(0) & (out < 0))
                out[front] = i
    return out


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, last: Callable = iter) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal leading columns; a run is bounded, as groups are split before.  The last column goes through ``last``."""
    key, run = None, []
    for batch in batches:
        *columns, blobs = (c.to_pylist() for c in batch.columns)
        for r in zip(*columns, last(blobs), strict=True):
            if r[:n_keys] != key:
                if run:
                    yield key, run
                key, run = r[:n_keys], []
            run.append(r[n_keys:])
    if run:
        yield key, run


def _stored(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _within(num: int, den: int, many: Callable, compare: Callable):
    def f(batches):
        out = []
        for (cluster, block), run in _groups(batches, 2, many):
            run = sorted({r[0]: r for r in run}.values(), key=lambda r: r[0])
            ids = [r[0] for r in run]
            root = components(compare([r[1] for r in run], num, den)).tolist() if len(run) > 1 else [0]
            out += [(cluster, block, i, ids[r]) for i, r in zip(ids, root, strict=True)]
            if len(out) > 20_000:
                yield _table(out, ("cluster", "block", "id", "root"))
                out = []
        if out:
            yield _table(out, ("cluster", "block", "id", "root"))

    return f


def _table(found: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return rows(**dict(zip(names, (np.array(x, np.int64) for x in zip(*found, strict=True)), strict=True)))


def _hubs(num: int, den: int, features: Callable):
    """Links each hub of a cluster to the cluster's first, which alone is held."""

    def f(batches):
        key = first = None
        for batch in batches:
            out = []
            for cluster, root, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = features(blob)
                if cluster != key:
                    key, first = cluster, (root, x)
                both = len(np.intersect1d(x, first[1], assume_unique=True))
                if den * both >= num * (len(x) + len(first[1]) - both):
                    out.append((cluster, root, first[0]))
            if out:
                yield _table(out, ("cluster", "root", "hub"))

    return f


def _across(num: int, den: int, features: Callable, compare: Callable):
    """Links between the rest of a cluster and one of its blocks."""

    def f(batches):
        for _, run in _groups(batches, 3):
            run.sort(key=lambda r: not r[0])
            left = sum(r[0] for r in run)
            if 0 < left < len(run):
                sets = [features(r[2]) for r in run]
                x, y = np.nonzero(compare(sets[:left], num, den, sets[left:]))
                root = np.array([r[1] for r in run])
                pairs = np.unique(np.stack([root[x], root[y + left]], 1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                if len(pairs):
                    yield rows(a=pairs[:, 0].copy(), b=pairs[:, 1].copy())

    return f


def _parts(block: int):
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.least(F.ceil(F.sum("n") / FEATURES), F.count(F.lit(1)))).cast("int")


def _split(scratch: Scratch, members: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """members (cluster, id, n, ...) of clusters of one block, and those of larger ones with their number of blocks, if any.

    n: a set's features.  A block holds ``block`` sets and FEATURES features, about.  Counted on the
    narrow table, so that features needn't be shuffled for it.
    """
    counts = scratch.table(members.groupBy("cluster").agg(_parts(block).alias("blocks")).where("blocks > 1"), "counts")
    if not counts.limit(1).count():
        return members, None
    return members.join(counts, "cluster", "left_anti"), scratch.table(members.join(counts, "cluster"), "hot")


def exact_components(
    scratch: Scratch,
    members: DataFrame,
    ship: Callable[[DataFrame], DataFrame],
    num: int,
    den: int,
    block: int = BLOCK,
    features: Callable = _stored,
    refine: Callable[[DataFrame, int], DataFrame] | None = None,
    turn: int = 0,
    compare: Callable = linked,
    many: Callable | None = None,
) -> DataFrame:
    """Links (id, root) among members (cluster, id, n, ...), whose components are those of den * overlap >= num * union.

    ship(some members) adds their feats, which ``features`` turns into a sorted array of hashes, and
    ``many``, where there is one, a list of them one after the other.
    Only members of one cluster are linked.  A member without links comes with itself, or not at all.
    compare may discard pairs that can't be linked before it does what ``linked`` does.

    A cluster of more than a block is dealt into blocks at random, and each block is solved alone.
    The largest component of each block is then compared through one of its members with that of the
    first block; nearly all of a large group of copies meets in this way.  What is left outside is
    compared with every block, so that no link is lost and no task holds more than a few blocks.
    Where more than two blocks are left outside, the cluster is no group of copies, but many sets
    that met by chance: it is cut by signatures of another make first.  refine(its members with feats,
    turn) returns (id, cluster) for those that meet others again.
    """
    within = lambda items: items.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(_within(num, den, many or partial(map, features), compare), "cluster long, block long, id long, root long")
    cold, hot = _split(scratch, members, block)
    out = scratch.table(within(ship(cold).select("cluster", F.lit(0).cast("long").alias("block"), "id", "feats")).select("id", "root"), "solved")
    if hot is None:
        return out
    if not turn:
        feats = scratch.table(ship(hot).select("id", "feats"), "feats")
        ship = lambda some: some.join(feats, "id")
    items = scratch.table(ship(hot).select("cluster", F.pmod(F.xxhash64("id"), "blocks").cast("long").alias("block"), "id", "feats", "n", "blocks"), "items")
    solved = scratch.table(within(items.select("cluster", "block", "id", "feats")), "solved")
    large = scratch.table(items.join(solved.select("id", "root"), "id"), "large")
    scratch.drop(items)
    sizes = large.groupBy("cluster", "block", "root").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("cluster", "block").agg(F.max_by("root", F.struct("n", "root")).alias("root"))
    hubs = large.where("id = root").join(mains.select("root"), "root", "left_semi").select("cluster", "root", "feats")
    met = hubs.repartition("cluster").sortWithinPartitions("cluster", "root").mapInArrow(_hubs(num, den, features), "cluster long, root long, hub long")
    met = scratch.table(met, "met")
    rest = large.join(met.select("root"), "root", "left_anti")
    chunks = scratch.table(rest.groupBy("cluster").agg(_parts(block).alias("chunks")), "chunks")
    if refine and turn < REFINEMENTS and chunks.where("chunks > 2").limit(1).count():
        loose = chunks.where("chunks > 2").select("cluster")
        again = hot.join(loose, "cluster", "left_semi")
        finer = scratch.table(again.drop("cluster", "blocks").join(refine(ship(again.select("cluster", "id")), turn), "id"), "finer")
        out = out.unionByName(exact_components(scratch, finer, ship, num, den, block, features, refine, turn + 1, compare, many))
        chunks = chunks.where("chunks <= 2")
    r = rest.join(chunks, "cluster").select("cluster", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), "chunks").cast("long").alias("chunk"), F.lit(True).alias("rest"), "root", "feats")
    b = large.join(chunks, "cluster").select("cluster", "block", F.explode(F.expr("sequence(0L, chunks - 1L)")).alias("chunk"), F.lit(False).alias("rest"), "root", "feats")
    links = r.unionByName(b).repartition("cluster", "block", "chunk").sortWithinPartitions("cluster", "block", "chunk").mapInArrow(_across(num, den, features, compare), "a long, b long")
    links = scratch.table(links.unionByName(met.select(F.col("root").alias("a"), F.col("hub").alias("b"))), "links")
    scratch.drop(large)
    return out.unionByName(solved.select("id", "root")).unionByName(links.select(F.col("a").alias("id"), F.col("b").alias("root")))
