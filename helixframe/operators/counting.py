"""Counting k-mers.

Windows of up to DIRECT bases are packed, summed by each task and then by one partially aggregated group-by: a
task has 4**DIRECT sums at most.  Longer ones are mostly distinct, so that sums would be as many as windows;
they travel as super-k-mers (see superkmers.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hpc, key_columns, packed_counts, saturate, unpacked
from .superkmers import count_superkmers

DIRECT = 11


def count_kmers(
    *sequences: DataFrame, k: int, strand: str = "canonical", compress: bool = False, suffix: str | None = None, value: int | None = None, label: int | None = None, keys: bool = False
) -> DataFrame:
    """(kmer, value[, label]) over all the sequences (bases, ...).

    strand: canonical, forward or reverse.  compress collapses homopolymers first; suffix keeps the
    k-mers that end with it; value and label give constants instead of the count and none.  keys
    leaves the k-mers packed (see functions.codes), as further operators take them.  Without a suffix,
    sequences are read at once where k is over DIRECT, and their super-k-mers written to the shared folder.
    """
    both = sequences[0].select("bases")
    for s in sequences[1:]:
        both = both.unionByName(s.select("bases"))
    if compress:
        both = both.select(hpc("bases").alias("bases"))
    if k > DIRECT and not suffix:
        out = count_superkmers(both, k, keys=True, strand=strand)
    else:
        out = packed_counts(both, k, strand, (suffix or "").upper()).groupBy(key_columns(k)).agg(saturate(F.sum("n")).alias("value"))
    if value is not None:
        out = out.withColumn("value", F.lit(value).cast("long"))
    out = out if label is None else out.withColumn("label", F.lit(label).cast("long"))
    return out if keys else unpacked(out, k)
