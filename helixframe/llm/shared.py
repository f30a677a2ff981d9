"""Spark helpers that the operators share: tables in the shared folder, fixed-size filters, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import squeeze, unsqueeze

MOST_BITS = 28  # of a filter: 32 MB
PART = 1024  # words of a filter that one row holds
FEW = 1 << 18  # links that one task may take together, 4 MB


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or what setCheckpointDir() was given.

    Only where both are unset and Spark runs on this machine alone, as in tests, a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def new_path(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.new_path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that is needed no more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.path.split(":", 1)[-1].lstrip("/") in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def _set_bits(bits: int, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]):
    """The parts of a task's bitmap in which a bit is set."""

    def f(batches):
        out = np.zeros(max(PART, 1 << bits - 5), np.uint32)
        for some in keys(batches):
            bit = some.astype(np.int64) & ((1 << bits) - 1)
            np.bitwise_or.at(out, bit >> 5, np.uint32(1) << (bit & 31).astype(np.uint32))
        out = out.reshape(-1, PART)
        for part in np.flatnonzero(out.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([squeeze(out[part].tobytes())], pa.binary())], names=["part", "words"])

    return f


def _or_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of all tasks as one each; rows come sorted by part."""
    part = words = None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([squeeze(words.tobytes())], pa.binary())], names=["part", "words"])

    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist(), strict=True):
            if p != part:
                if words is not None:
                    yield out()
                part, words = p, np.zeros(PART, np.uint32)
            words |= np.frombuffer(unsqueeze(blob), np.uint32)
    if words is not None:
        yield out()


def bitmap_of(rows: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], n: int) -> np.ndarray:
    """A bitmap with a bit set for each of the n keys that keys() finds in the rows: no key is missed, and few others pass.

    It has 16 bits a key, rounded up, but never more than 2**MOST_BITS (32 MB), so that it may be sent
    to every task; beyond some 16 million keys ever more others pass, and beyond 10**9 nearly all.  An
    exact join has to follow, so that results don't depend on it.
    """
    bits = min(MOST_BITS, max(15, int(n).bit_length() + 4))
    found = rows.mapInArrow(_set_bits(bits, keys), "part int, words binary").repartition("part").sortWithinPartitions("part").mapInArrow(_or_parts, "part int, words binary")
    out = np.zeros((max(1, (1 << bits - 5) // PART), PART), np.uint32)
    for r in found.collect():
        out[r["part"]] = np.frombuffer(unsqueeze(r["words"]), np.uint32)
    return out.ravel()


def membership(keys: DataFrame, column: str) -> np.ndarray:
    """bitmap_of() a column of longs whose lowest bits are as good as random, or that few rows share."""
    keys = keys.select(F.col(column).alias("key"))
    return bitmap_of(keys, lambda batches: (batch.column("key").to_numpy() for batch in batches), keys.count())


def maybe_in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys.astype(np.int64) & (len(bitmap) * 32 - 1)
    return (bitmap[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the least node that each reaches."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return node, node[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task as stars around the least node, a million links at a time."""
    held, size = [], 0

    def out():
        node, root = least_reached(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        other = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], names=["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += len(batch)
        if size > 1_000_000:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _stars(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) by alternating large-star and small-star steps, for links that leave no small number of roots."""
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, scratch.table(small, "edges")
        scratch.drop(old)
    return _rooted(edges)


def _rooted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def connected_components(scratch: Scratch, edges: DataFrame, contracted: bool = False) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node that can be reached.

    Distributed union-find by levels.  Each task makes stars of the links that it has.  A node with
    roots from several tasks takes the least of them, and links the others to it; so does a root that
    has a root elsewhere.  These links between roots, which are far fewer, are the next level.  A node
    has one link a task at most, so that no key is hot, and no component meets in one task.  As soon
    as there are FEW links or fewer, one task takes them all; links that leave more than half as many
    between roots, such as long chains, go through large-star and small-star steps instead.
    contracted: edges are distinct stars' already.
    """
    if not contracted:
        edges = edges.where("a <> b").select("a", "b").mapInArrow(_contracted, "a long, b long").distinct()
    edges = scratch.table(edges, "edges")
    n = edges.count()
    if n <= FEW:
        return _rooted(scratch.table(edges.coalesce(1).mapInArrow(_contracted, "a long, b long"), "edges"))
    least = scratch.table(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    roots = edges.select("b").distinct()
    between = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    between = between.unionByName(least.join(roots.select(F.col("b").alias("a")), "a", "left_semi").select("a", F.col("m").alias("b")))
    between = scratch.table(between.distinct(), "between")
    if between.count() > n / 2:
        return _stars(scratch, edges)
    upper = connected_components(scratch, between).select(F.col("node").alias("r"), F.col("root").alias("to"))
    nodes = least.select(F.col("a").alias("node"), "m").unionByName(roots.join(least.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("b").alias("node"), F.col("b").alias("m")))
    return nodes.join(upper, nodes["m"] == upper["r"], "left").select("node", F.coalesce("to", "m").alias("root"))
