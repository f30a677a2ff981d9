"""Stored k-mer datasets: bucketed, sorted tables of packed k-mers with a sidecar.

A dataset is a folder with ``_kmers.json`` and the data it names.  The sidecar holds what the rows don't
say (k, strand, label width, multiset, buckets, number of k-mers) and is put in place by one rename
after the data, so that a reader sees the old dataset or the new one.

Datasets with as many buckets are merged without a shuffle: they are read as the partitions of one
bucketed table, of which Spark reads each bucket's files together.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import key_columns, packed
from .datasets import import_list, read_list
from .sequences import read_sequences

SIDECAR = "_kmers.json"
BUCKETS = 64
DISTINCT = 1 << 20  # values whose occurrences a writing task holds


@dataclass(frozen=True)
class Meta:
    k: int
    strand: str = "canonical"
    label_bits: int = 0
    multiset: bool = False
    buckets: int = BUCKETS
    n: int = 0
    total: int = 0
    histogram: bool = False
    batch: int = -1
    data: str = ""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir() was given; a temporary one on this machine alone."""
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


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one rename."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    tmp, fs = _file(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    target = fs.makeQualified(_file(spark, path)[0])
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), target, how)


def meta_of(spark: SparkSession, path: str) -> Meta | None:
    """The sidecar of a dataset; None where the path has none."""
    p, fs = _file(spark, f"{path.rstrip('/')}/{SIDECAR}")
    if not fs.exists(p):
        return None
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
    stream.close()
    return Meta(**json.loads(text))


def _with_partial_histograms(keys: list[str], label: bool):
    """Rows as they are, with kind 0, and the occurrences of each value that the task met, with kind 1."""
    names = [*keys, "value", *(["label"] if label else []), "occurrences", "kind"]

    def partial(counts: dict[int, int]) -> pa.RecordBatch:
        n = len(counts)
        nulls = [pa.nulls(n, pa.int64())] * len(keys)
        return pa.RecordBatch.from_arrays([*nulls, pa.array(counts, pa.int64()), *([pa.nulls(n, pa.int64())] if label else []), pa.array(counts.values(), pa.int64()), pa.array(np.ones(n, np.int32))], names=names)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            value, n = np.unique(batch.column("value").to_numpy(), return_counts=True)
            for v, m in zip(value.tolist(), n.tolist(), strict=True):
                counts[v] = counts.get(v, 0) + m
            if len(counts) > DISTINCT:
                yield partial(counts)
                counts.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(len(batch), pa.int64()), pa.array(np.zeros(len(batch), np.int32))], names=names)
        if counts:
            yield partial(counts)

    return f


def store(db: DataFrame, path: str, k: int, strand: str = "canonical", label_bits: int = 64, multiset: bool = False, buckets: int = BUCKETS, histogram: bool = False, batch: int = -1) -> Meta:
    """Write a dataset (kmer or packed keys, value[, label]) in one job; an existing one at the path is replaced.

    The numbers of k-mers and of all occurrences are observed while it is written; histogram has the
    writing tasks add their parts of the histogram, too (see stored_histogram).
    """
    spark, keys, path = db.sparkSession, key_columns(k), path.rstrip("/")
    label = "label" in db.columns
    old = meta_of(spark, path)
    seen = Observation()
    rows = packed(db, k).select(*keys, F.col("value").cast("long").alias("value"), *([F.col("label").cast("long").alias("label")] if label else [])).repartition(buckets, *keys)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"))
    if histogram:
        rows = rows.mapInArrow(_with_partial_histograms(keys, label), ", ".join(f"{c} long" for c in rows.columns) + ", occurrences long, kind int")
    else:
        rows = rows.withColumn("kind", F.lit(0))
    name, data = f"helixframe_{uuid.uuid4().hex}", f"data-{uuid.uuid4().hex}"
    rows.write.format("parquet").partitionBy("kind").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/{data}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    found = seen.get
    meta = Meta(k, strand, label_bits if label else 0, multiset, buckets, found["n"], found["total"], histogram, batch, data)
    _put(spark, f"{path}/{SIDECAR}", json.dumps(asdict(meta)))
    if old:
        p, fs = _file(spark, f"{path}/{old.data}")
        fs.delete(p, True)
    return meta


def metas_of(spark: SparkSession, paths: tuple[str, ...]) -> list[Meta]:
    """The sidecars of datasets that are to be used together; raises ValueError where they don't fit."""
    metas = [meta_of(spark, p) for p in paths]
    for path, m in zip(paths, metas, strict=True):
        if m is None:
            raise ValueError(f"{path} is no stored dataset")
    for what in ("k", "strand"):
        if len({getattr(m, what) for m in metas}) > 1:
            raise ValueError(f"the datasets differ in {what}: " + ", ".join(f"{p} has {getattr(m, what)}" for p, m in zip(paths, metas, strict=True)))
    if len({m.label_bits for m in metas if m.label_bits}) > 1:
        raise ValueError("the datasets differ in the width of their labels")
    return metas


def tagged_stored(spark: SparkSession, *paths: str) -> DataFrame:
    """(keys, idx, value, label) of stored datasets with unique k-mers; idx counts from 0, and a missing label is 0.

    Where all have as many buckets, the rows come partitioned by the keys.
    """
    metas = metas_of(spark, paths)
    if len(paths) > 1 and any(m.multiset for m in metas):
        raise ValueError("multisets have more than one row a k-mer and can't be merged")
    keys, label = key_columns(metas[0].k), any(m.label_bits for m in metas)
    if len({m.buckets for m in metas}) > 1:
        out = None
        for i, p in enumerate(paths):
            part = tagged_stored(spark, p).withColumn("idx", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out
    by, columns = ", ".join(keys), ", ".join(f"{c} BIGINT" for c in (*keys, "value", *(["label"] if label else [])))
    name = f"helixframe_{uuid.uuid4().hex}"
    folder = lambda i: f"{paths[i].rstrip('/')}/{metas[i].data}/kind=0"
    spark.sql(f"CREATE TABLE {name} ({columns}, idx INT) USING parquet OPTIONS (path '{shared_folder(spark)}/{name}') PARTITIONED BY (idx) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {metas[0].buckets} BUCKETS")
    spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION (idx={i}) LOCATION '{folder(i)}'" for i in range(len(paths))))
    zero = F.lit(0).cast("long")
    return spark.table(name).select(*keys, "idx", "value", (F.coalesce("label", zero) if label else zero).alias("label"))


def read_stored(spark: SparkSession, path: str, begins: str = "") -> DataFrame:
    """(keys, value[, label]) of a stored dataset; begins reads the k-mers that begin with these bases alone, a range of each sorted bucket."""
    meta = metas_of(spark, (path,))[0]
    rows = tagged_stored(spark, path).drop("idx")
    if begins:
        if len(begins) > min(31, meta.k if meta.k < 32 else meta.k - 32):
            raise ValueError("so many bases don't lead the first word of a k-mer")
        n = meta.k if meta.k < 32 else meta.k - 32
        low = sum("ACTG".index(x) << 2 * i for i, x in enumerate(reversed(begins))) << 2 * (n - len(begins))
        high, half = low + (1 << 2 * (n - len(begins))) - 1, 0 if meta.k < 32 else 1 << 63
        rows = rows.where(F.col("code").between(low - half, high - half))
    return rows if meta.label_bits else rows.drop("label")


def stored_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(value, occurrences) as the tasks that wrote the dataset counted them."""
    meta = metas_of(spark, (path,))[0]
    if not meta.histogram:
        raise ValueError(f"{path} was written without a histogram")
    parts = spark.read.schema("value long, occurrences long").parquet(f"{path.rstrip('/')}/{meta.data}/kind=1") if meta.n else spark.createDataFrame([], "value long, occurrences long")
    return parts.groupBy("value").agg(F.sum("occurrences").alias("occurrences"))


def kind_of(spark: SparkSession, path: str) -> str:
    """What a path holds: dataset (it has a sidecar), list (k-mers with values, or directives), or sequences."""
    if meta_of(spark, path):
        return "dataset"
    first = spark.read.text(path).where(F.col("value").rlike(r"\S")).limit(1).collect()
    is_list = bool(first) and bool(re.match(r"(#|value=|label=)[0-9]+\s*$|[ACGTacgt]+[ \t]+[0-9]+", first[0]["value"].strip()))
    return "list" if is_list else "sequences"


def open_input(spark: SparkSession, path: str, k: int | None = None, strand: str = "canonical") -> tuple[str, DataFrame]:
    """What a path holds (see kind_of) and its rows: (keys, value[, label]) of a dataset, (kmer, value, label) of a list, ([seq_idx,] ident, bases) of sequences.

    k and strand, if they are given, have to be those of a stored dataset; a list is read on the strand.
    """
    kind = kind_of(spark, path)
    if kind == "dataset":
        meta = metas_of(spark, (path,))[0]
        if k not in (None, meta.k) or strand != meta.strand:
            raise ValueError(f"{path} has {meta.strand} {meta.k}-mers")
        return kind, read_stored(spark, path)
    if kind == "list":
        return kind, import_list(read_list(spark, path), strand)
    return kind, read_sequences(spark, path, ordinals=True)
