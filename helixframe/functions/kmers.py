"""Columns over sequences and k-mers; all are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U32_MAX = 4294967295
CHUNK = 4096  # bases of a sequence that are cut into windows at once


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(F.translate(_col(c), "ACGT", "TGCA"))


def sort_key(c: Column | str) -> Column:
    """A string that sorts k-mers by A < C < T < G."""
    return F.translate(_col(c), "ACTG", "0123")


def canonical(c: Column | str) -> Column:
    """The lesser of a k-mer and its reverse complement, by A < C < T < G."""
    r = reverse_complement(c)
    return F.when(sort_key(c) <= sort_key(r), _col(c)).otherwise(r)


def canonical_acgt(c: Column | str) -> Column:
    """The lesser of both strands, by A < C < G < T."""
    return F.least(_col(c), reverse_complement(c))


def hpc(c: Column | str) -> Column:
    """Homopolymer compression: each run of one base becomes that base."""
    return F.regexp_replace(_col(c), "(.)\\1+", "$1")


def base_count(c: Column | str, letters: str) -> Column:
    """How many of a k-mer's bases are among the letters."""
    return F.length(_col(c)) - F.length(F.translate(_col(c), letters, ""))


def run_score(c: Column | str, two: str) -> Column:
    """Total length of the maximal runs of two letters that hold both."""
    runs = F.filter(F.regexp_extract_all(_col(c), F.lit(f"([{two}]+)"), F.lit(1)), lambda x: x.contains(two[0]) & x.contains(two[1]))
    return F.aggregate(runs, F.lit(0), lambda s, x: s + F.length(x))


def encode(c: Column | str) -> Column:
    """A k-mer of up to 31 bases as a long of two bits a base, which sorts as the k-mers do."""
    return F.conv(sort_key(c), 4, 10).cast("long")


def decode(c: Column | str, k: int) -> Column:
    """The k-mer that encode() made a long of."""
    return F.translate(F.lpad(F.conv(_col(c).cast("string"), 10, 4), k, "0"), "0123", "ACTG")


def saturate(c: Column | str) -> Column:
    """A count kept within 32 unsigned bits."""
    return F.least(_col(c), F.lit(U32_MAX)).cast("long")


def windows(sequences: DataFrame, k: int, *keep: str, chunk: int = CHUNK) -> DataFrame:
    """(*keep, pos, kmer): all k-mers of ``bases`` as read, with positions from 0; none spans another letter than ACGT.

    Sequences are cut into chunks that overlap by k-1 bases in one linear pass, and spread out by
    chunk, so that a long sequence neither costs quadratic time nor stays one row.
    """
    if not 1 <= k <= 64:
        raise ValueError("k has to be between 1 and 64")
    pieces = F.regexp_extract_all("bases", F.lit(f"(.{{1,{chunk}}})"), F.lit(1))
    s = sequences.select(*keep, pieces.alias("_p"))
    whole = F.transform("_p", lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(F.col("_p"), i + 1), F.lit("")), 1, k - 1)))
    s = s.select(*keep, F.posexplode(whole).alias("_i", "_c"))
    s = s.select(*keep, "_i", F.posexplode(F.regexp_extract_all("_c", F.lit(f"(?=(.{{{k}}}))"), F.lit(1))).alias("_j", "kmer"))
    return s.where(~F.col("kmer").rlike("[^ACGT]")).select(*keep, (F.col("_i") * chunk + F.col("_j")).cast("long").alias("pos"), "kmer")
