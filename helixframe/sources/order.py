"""Ranges of an order, for running totals that no single task can make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def ranged(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """df with part: the number of the range of the order column, by bounds from a sample.

    The bounds are constants of the plan, so that whoever evaluates it again gets the same parts.
    """
    n = df.count()
    sample = df.select(order).sample(min(1.0, 20 * ranges / max(1, n)), 1).orderBy(order).limit(40 * ranges).collect()
    bounds = [sample[len(sample) * i // ranges][0] for i in range(1, ranges)] if len(sample) >= ranges else []
    kind = df.schema[order].dataType
    above = F.size(F.filter(F.array(*[F.lit(x).cast(kind) for x in bounds]), lambda x: x <= F.col(order))) if bounds else F.lit(0)
    return df.withColumn("part", above)


def running(df: DataFrame, order: str, amount, ranges: int = RANGES) -> DataFrame:
    """df with before: the sum of the amount over all rows that come earlier in the order."""
    r = ranged(df, order, ranges).withColumn("amount", amount)
    sums = r.groupBy("part").agg(F.sum("amount").alias("sum"))  # a row for each range
    sums = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("earlier"))
    w = Window.partitionBy("part").orderBy(order)
    r = r.join(F.broadcast(sums), "part").withColumn("before", F.col("earlier") + F.sum("amount").over(w) - F.col("amount"))
    return r.select(*df.columns, "before")
