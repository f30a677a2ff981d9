"""Counting over a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import canonical, windows
from ..operators.combine import combine
from ..operators.counting import count_kmers
from ..sources.stored import BUCKETS, meta_of, read_stored, store


def stream_counts(sequences: DataFrame, k: int) -> DataFrame:
    """Canonical counts of a streaming DataFrame with a column bases, for update or complete mode.

    The state holds a row for each distinct k-mer.
    """
    return windows(sequences, k).select(canonical("kmer").alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("value"))


def stream_into(sequences: DataFrame, path: str, k: int, checkpoint: str, strand: str = "canonical", buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer that adds the counts of a streaming DataFrame with a column bases to the stored dataset at the path.

    Each batch is merged once: the dataset's sidecar, put in place with the merged data, names the last
    batch in it, so that a batch that is repeated after a failure is passed over.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = meta_of(spark, path)
        if old and (old.k, old.strand) != (k, strand):
            raise ValueError(f"{path} has {old.strand} {old.k}-mers")
        if old and number <= old.batch:
            return
        new = count_kmers(batch, k=k, strand=strand, keys=True)
        store(combine("union-sum", read_stored(spark, path), new) if old else new, path, k, strand, buckets=old.buckets if old else buckets, batch=number)

    return sequences.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
