"""Sequence sources: FASTA, FASTQ, and a projection of prose onto bases.

Readers can number records: seq_idx counts from 0 by file name, then by place in the file, whatever the
splits.  Each split's records are counted, and the counts of those before it added to their numbers
within the split, so that no record is shuffled.  It costs a second reading of the files, and is done
with ``ordinals=True``.
"""

from __future__ import annotations

import lzma
import string

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .order import running

LETTERS = string.ascii_lowercase
BASES = ("ACGT" * 7)[:26]


MANY_SPLITS = 1 << 20  # whose counts are broadcast, 24 MB; more are joined
INFLATED = 1 << 20  # bytes of an xz file that are held at once


def _xz(sep: str):
    """Records of whole xz files, inflated a piece at a time."""

    def rows(path, records):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(records)), pa.array(records, pa.binary()).cast(pa.string())], names=["file", "value"])

    def f(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rest = b""
                with lzma.open(pa.BufferReader(content.as_buffer())) as file:
                    while piece := file.read(INFLATED):
                        *records, rest = (rest + piece).split(sep.encode())
                        if records:
                            yield rows(path, records)
                yield rows(path, [rest])

    return f


def _is_xz(spark: SparkSession, path: str) -> bool:
    """Whether a path is an xz file, a pattern of such, or a folder with xz files alone."""
    if path.endswith(".xz"):
        return True
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if any(c in path for c in "*?[{") or not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return False
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    names = [x for x in names if not x.startswith(("_", "."))]
    return bool(names) and all(x.endswith(".xz") for x in names)


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, value) of the records of text files; an xz file is read by one task."""
    if not _is_xz(spark, path):
        return spark.read.option("lineSep", sep).text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "value")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_xz(sep), "file string, value string").select("file", F.lit(0).cast("long").alias("block"), "value")


def _with_ordinals(found: DataFrame, columns: list[str], ordinals: bool, row=None) -> DataFrame:
    """The columns of records (file, block, ...), each split's in order, with seq_idx first.

    row: a record's number within its split, if that isn't the order of the rows.
    """
    if not ordinals:
        return found.select(columns)
    placed = found.withColumn("_row", F.monotonically_increasing_id() if row is None else row)
    splits = placed.groupBy("file", "block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("file", "block")  # a row for each split
    splits = splits.select("file", "block", "_first", (F.sum("_n").over(w) - F.col("_n")).alias("_before")).persist()
    n = splits.count()
    joined = placed.join(F.broadcast(splits) if n <= MANY_SPLITS else splits, ["file", "block"])
    return joined.select((F.col("_row") - F.col("_first") + F.col("_before")).alias("seq_idx"), *columns)


def _written(records: DataFrame) -> DataFrame:
    """Records that aren't white space alone."""
    return records.where(F.col("value").rlike(r"\S"))


def _right_trimmed(c):
    return F.regexp_replace(c, r"\s+$", "")


def read_fasta(spark: SparkSession, path: str, ordinals: bool = False) -> DataFrame:
    """([seq_idx,] ident, bases) of FASTA files (also .gz, .bz2 and .xz); records are split by Spark's reader, not collected by file."""
    record = F.regexp_replace("value", "^>", "")
    head = F.substring_index(record, "\n", 1)
    body = F.substring(record, F.length(head) + 2, F.length(record))
    found = _written(_records(spark, path, "\n>")).select("file", "block", F.trim(_right_trimmed(head)).alias("ident"), F.upper(F.regexp_replace(body, r"\s", "")).alias("bases"))
    return _with_ordinals(found, ["ident", "bases"], ordinals)


def read_raw(spark: SparkSession, path: str, ordinals: bool = False) -> DataFrame:
    """([seq_idx,] ident, bases) of files with a sequence a line and no names: ident is null."""
    found = _written(_records(spark, path, "\n")).select("file", "block", F.lit(None).cast("string").alias("ident"), F.upper(F.regexp_replace("value", r"\s", "")).alias("bases"))
    return _with_ordinals(found, ["ident", "bases"], ordinals)


def _fastq(batches):
    """Records (ident, bases, quals) of pieces cut before each @ that begins a line, in the order of their file.

    Such an @ may begin the qualities, too; these follow a piece of three lines.  A task's first and
    last pieces may belong to other tasks: they go out as rows of a kind of their own.
    """
    names = ("kind", "file", "block", "row", "ident", "bases", "quals")
    where, three, row = None, None, 0
    out: list[tuple] = []

    def table():
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return done

    for batch in batches:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != where:
                if three:
                    out.append((1, *where, row, *three, None))
                where, three, row = (file, block), None, 0
            lines = [x.rstrip("\r") for x in value.split("\n")]
            if len(lines) >= 4 or (len(lines) == 3 and lines[2].startswith("+") and not three):
                if not three and lines[0].startswith("@"):
                    lines[0] = lines[0][1:]
                three = (lines[0].strip(), lines[1].strip().upper())
                if len(lines) >= 4:
                    out.append((0, file, block, row, *three, lines[3].strip()))
                    three, row = None, row + 1
            elif three:
                out.append((0, file, block, row, *three, "@" + lines[0].strip()))
                three, row = None, row + 1
            else:
                out.append((2, file, block, None, None, None, "@" + lines[0].strip()))
            if len(out) >= 1000:
                yield table()
    if three:
        out.append((1, *where, row, *three, None))
    if out:
        yield table()


def read_fastq(spark: SparkSession, path: str, ordinals: bool = False) -> DataFrame:
    """([seq_idx,] ident, bases, quals) of four-line FASTQ files (also .gz, .bz2 and .xz), whatever their qualities begin with.

    Where a file is split between a record's bases and qualities, the two meet by the place of the split.
    """
    found = _records(spark, path, "\n@").mapInArrow(_fastq, "kind int, file string, block long, row long, ident string, bases string, quals string")
    w = Window.partitionBy("file").orderBy("block", F.desc("kind"))  # at most two rows a split: its first piece, then its last
    cut = found.where("kind > 0").withColumn("quals", F.lead("quals").over(w)).where("kind = 1")
    return _with_ordinals(found.where("kind = 0").unionByName(cut), ["ident", "bases", "quals"], ordinals, F.col("row"))


def read_sequences(spark: SparkSession, path: str, ordinals: bool = False) -> DataFrame:
    """([seq_idx,] ident, bases) of files that are FASTA, FASTQ or raw by how the first of them begins."""
    first = _written(_records(spark, path, "\n")).limit(1).collect()
    begins = first[0]["value"].lstrip()[:1] if first else ">"
    found = {">": read_fasta, "@": read_fastq}.get(begins, read_raw)(spark, path, ordinals)
    return found.drop("quals")


def _name():
    """The name of a record, empty where it has none."""
    return F.coalesce(F.col("ident").cast("string"), F.lit(""))


def _in_order(sequences: DataFrame, files: int) -> DataFrame:
    """Records by their number, where they have one."""
    return sequences.repartitionByRange(files, "seq_idx").sortWithinPartitions("seq_idx") if "seq_idx" in sequences.columns else sequences


def write_fasta(sequences: DataFrame, path: str, files: int = 64) -> None:
    _in_order(sequences, files).select(F.concat(F.lit(">"), _name(), F.lit("\n"), "bases").alias("value")).write.text(path)


def write_found(sequences: DataFrame, path: str, files: int = 64) -> None:
    """Sequences (ident, bases, n_kmers[, quals]) as FASTA, or as FASTQ where quals isn't null, in the order of seq_idx; the number found follows the name."""
    head = F.concat(_name(), F.lit(" nKmers="), F.col("n_kmers").cast("string"), F.lit("\n"), F.col("bases"))
    record = F.concat(F.lit(">"), head)
    if "quals" in sequences.columns:
        record = F.when(F.col("quals").isNull(), record).otherwise(F.concat(F.lit("@"), head, F.lit("\n+\n"), "quals"))
    _in_order(sequences, files).select(record.alias("value")).write.text(path)


def numbered(sequences: DataFrame, order: str) -> DataFrame:
    """The sequences with ident: the number of the record in the order, from 0."""
    return running(sequences.drop("ident"), order, F.lit(1).cast("long")).withColumnRenamed("before", "ident")


def with_ordinals(sequences: DataFrame, order: str) -> DataFrame:
    """The sequences with seq_idx: the number of the record in the order, from 0; names stay as they are."""
    return running(sequences, order, F.lit(1).cast("long")).withColumnRenamed("before", "seq_idx")


def broken_bases(text: str = "text"):
    """Prose as bases: letters map to ACGT in turn, all else to N, which breaks k-mers."""
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, BASES), "[^ACGT]", "N")


def unbroken_bases(text: str = "text"):
    """Prose as bases, without its other characters."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES)


def segment(sequences: DataFrame, order: str, n: int, m: int) -> DataFrame:
    """Segment n (from 1) of m: the sequences, in order, by their share of all bases; the last takes what is left."""
    total = sequences.agg(F.sum(F.length("bases")).alias("total")).first()["total"] or 0
    size = max(1, total // m)
    placed = running(sequences, order, F.length("bases").cast("long"))
    return placed.where(F.least(F.floor(F.col("before") / size), F.lit(m - 1)) == n - 1).select(sequences.columns)
