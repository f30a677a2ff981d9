"""Histogram, statistics, thresholds, noise and coverage peaks, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(db: DataFrame) -> DataFrame:
    """(value, occurrences)."""
    return db.groupBy("value").agg(F.count(F.lit(1)).alias("occurrences"))


def _running(h: DataFrame) -> DataFrame:
    # the histogram has a row for each distinct value, far fewer than k-mers
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("value") * F.col("occurrences")
    every = Window.partitionBy()
    return h.select("value", "occurrences", F.sum("occurrences").over(w).alias("cd"), F.sum(total).over(w).alias("ct"), F.sum("occurrences").over(every).alias("distinct"), F.sum(total).over(every).alias("total"))


def threshold_distinct(db: DataFrame, f: float) -> DataFrame:
    """One row: the least value at which the distinct k-mers so far reach floor(f * all distinct)."""
    return _running(histogram(db)).where(F.col("cd") >= F.floor(F.lit(f) * F.col("distinct"))).agg(F.min("value").alias("threshold"))


def threshold_word_frequency(db: DataFrame, f: float) -> DataFrame:
    """One row: floor(f * sum of all values)."""
    return db.agg(F.floor(F.lit(f) * F.coalesce(F.sum("value"), F.lit(0))).cast("long").alias("threshold"))


def _missing(k: int) -> Column:
    """4**k less the distinct ones, as text; no decimal holds 4**64, so that its digits come in two parts."""
    number = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    distinct = F.col("distinct").cast("decimal(38,0)")
    if k < 64:
        return (number(4**k) - distinct).cast("decimal(38,0)").cast("string")
    high, low = divmod(4**64, 10**19)
    borrow = distinct > number(low)
    first = (number(high) - borrow.cast("int")).cast("decimal(38,0)").cast("string")
    rest = (number(low) + F.when(borrow, number(10**19)).otherwise(number(0)) - distinct).cast("decimal(38,0)").cast("string")
    return F.concat(first, F.lpad(rest, 19, "0"))


def statistics(db: DataFrame, k: int) -> DataFrame:
    """The histogram with running shares, and the counts of unique, distinct, present and missing k-mers in each row.

    missing, as text, is 4**k less the distinct ones.
    """
    unique = F.sum(F.when(F.col("value") == 1, F.col("occurrences")).otherwise(0)).over(Window.partitionBy())
    return _running(histogram(db)).select(
        "value", "occurrences", (F.col("cd") / F.col("distinct")).alias("cum_distinct_frac"), (F.col("ct") / F.col("total")).alias("cum_total_frac"), (F.col("value") * 1000000.0 / F.col("total")).alias("per_million"),
        unique.alias("unique_kmers"), F.col("distinct").alias("distinct_kmers"), F.col("total").alias("present_kmers"), _missing(k).alias("missing_kmers"),
    )


def ploidy(h: DataFrame) -> DataFrame:
    """One row (noise, p1, p2, p3, p4): the first trough of the smoothed histogram, and the greatest peak after it with its multiples.

    An own definition: counts are smoothed over five values; p1 is the peak's value.
    """
    w = Window.orderBy("value")
    smooth = h.withColumn("s", F.avg("occurrences").over(w.rowsBetween(-2, 2)))
    smooth = smooth.withColumn("before", F.lag("s").over(w)).withColumn("after", F.lead("s").over(w))
    noise = smooth.where("s <= before and s < after").agg(F.min("value").alias("noise"))
    peak = smooth.crossJoin(F.broadcast(noise)).where("value > coalesce(noise, 0)").agg(F.max("noise").alias("noise"), F.max_by("value", F.struct("s", -F.col("value"))).cast("double").alias("p1"))
    return peak.select(F.col("noise").cast("double").alias("noise"), "p1", *[(F.col("p1") * i).alias(f"p{i}") for i in (2, 3, 4)])
