"""k-mer datasets: (kmer, value[, label]) as Parquet, as tab-separated lists, and from text lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, canonical_acgt, reverse_complement, saturate, sort_key
from .order import ranged


def write_dataset(db: DataFrame, path: str, buckets: int | None = None) -> None:
    """Parquet, laid out by the k-mer's first three bases so that a slice is read alone."""
    db.withColumn("slice", F.substring("kmer", 1, 3)).repartition(*([buckets] if buckets else []), "slice").sortWithinPartitions(sort_key("kmer")).write.mode("overwrite").partitionBy("slice").parquet(path)


def read_dataset(spark: SparkSession, path: str, slice_of: str | None = None) -> DataFrame:
    db = spark.read.parquet(path)
    return (db.where(F.col("slice") == slice_of) if slice_of else db).drop("slice")


def printed(db: DataFrame, acgt: bool = False) -> DataFrame:
    """(position key, line) of a printed dataset; acgt prints the lesser strand by A < C < G < T without sorting anew."""
    kmer = canonical_acgt("kmer") if acgt else F.col("kmer")
    label = [F.conv(F.col("label").cast("string"), 10, 2)] if "label" in db.columns else []
    return db.select(sort_key("kmer").alias("key"), F.concat_ws("\t", kmer, F.col("value").cast("string"), *label).alias("line"))


def write_list(db: DataFrame, path: str, files: int = 64, acgt: bool = False, compression: str | None = None) -> None:
    """Sorted text files of kmer<tab>value[<tab>label], ranges of the key order."""
    lines = printed(db, acgt).repartitionByRange(files, "key").sortWithinPartitions("key").select("line")
    (lines.write.option("compression", compression) if compression else lines.write).text(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="value long, occurrences long")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, word1, word2, word3) of a text file, for import_list().

    line grows along the file: where the split begins, and how many lines precede in the split, which
    are fewer than its bytes.
    """
    raw = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return raw.select((F.input_file_block_start() + row).alias("line"), *[F.get(words, F.lit(i)).alias(f"word{i + 1}") for i in range(3)])


def import_list(lines: DataFrame, strand: str = "canonical", multiset: bool = False) -> DataFrame:
    """(kmer, value, label) from lines (line, word1, word2, word3): a k-mer, an optional value and an optional label.

    ``#N``, or ``value=N`` and ``label=N``, set the value or label of the lines that follow without
    one.  Duplicates are summed, their labels or-ed, unless multiset keeps them.  Directives need the
    order of lines: a list that has any is cut into ranges of lines, and the last directives of each
    are carried to the next; without, nothing is sorted.
    """
    w1 = F.col("word1")
    is_value, is_label = w1.rlike("^(#|value=)[0-9]+$"), w1.rlike("^label=[0-9]+$")
    number = F.regexp_extract(w1, "([0-9]+)$", 1).cast("long")
    marked = lines.withColumn("_v", F.when(is_value, number)).withColumn("_l", F.when(is_label, number))
    if marked.where(is_value | is_label).limit(1).count():
        marked = ranged(marked, "line")
        last = marked.where(is_value | is_label).groupBy("part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c) for c in ("_v", "_l")])
        every = marked.select("part").distinct().join(last, "part", "left")  # a row for each range
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select("part", F.last("_v", True).over(before).alias("_cv"), F.last("_l", True).over(before).alias("_cl"))
        w = Window.partitionBy("part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("_v", F.last("_v", True).over(w)).withColumn("_l", F.last("_l", True).over(w)).join(F.broadcast(carried), "part")
        marked = marked.withColumn("_v", F.coalesce("_v", "_cv")).withColumn("_l", F.coalesce("_l", "_cl"))
    rows = marked.where(~(is_value | is_label)).select(
        stranded(F.upper("word1"), strand).alias("kmer"), F.coalesce(F.col("word2").cast("long"), "_v", F.lit(1)).alias("value"), F.coalesce(F.col("word3").cast("long"), "_l", F.lit(0)).alias("label")
    )
    rows = rows.where("kmer rlike '^[ACGT]+$'")
    if multiset:
        return rows.where("value > 0")
    return rows.groupBy("kmer").agg(saturate(F.sum("value")).alias("value"), F.bit_or("label").alias("label")).where("value > 0")


def stranded(kmer: Column, strand: str) -> Column:
    return {"canonical": canonical, "forward": lambda c: c, "reverse": reverse_complement}[strand](kmer)
