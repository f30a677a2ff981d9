"""Filters on the value and arithmetic with it.  A value of 0 means absent and is never kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import U32_MAX, saturate
from .reports import threshold_distinct, threshold_word_frequency

RELATIONS = {
    "less-than": lambda a, b: a < b,
    "greater-than": lambda a, b: a > b,
    "at-least": lambda a, b: a >= b,
    "at-most": lambda a, b: a <= b,
    "equal-to": lambda a, b: a == b,
    "not-equal-to": lambda a, b: a != b,
}


def present(db: DataFrame) -> DataFrame:
    return db.where("value > 0")


def select_value(db: DataFrame, relation: str, x: int | None = None, distinct: float | None = None, word_frequency: float | None = None) -> DataFrame:
    """Keeps the k-mers whose value stands in the relation to x, or to a threshold found in the histogram."""
    if sum(v is not None for v in (x, distinct, word_frequency)) != 1:
        raise ValueError("one of x, distinct and word_frequency is needed")
    if x is not None:
        return db.where(RELATIONS[relation](F.col("value"), F.lit(x)))
    limit = threshold_distinct(db, distinct) if distinct is not None else threshold_word_frequency(db, word_frequency)
    return db.crossJoin(F.broadcast(limit)).where(RELATIONS[relation](F.col("value"), F.col("threshold"))).drop("threshold")  # one row


def select_threshold(relation: str, *dbs: DataFrame, value: str = "first", distinct: float | None = None, word_frequency: float | None = None) -> DataFrame:
    """A selector with a threshold of the histogram on its right side: it needs one input, whose value the operation leaves as it is."""
    if len(dbs) != 1:
        raise ValueError("distinct and word_frequency need exactly one input")
    if value != "first":
        raise ValueError("distinct and word_frequency need the value of the input, unchanged")
    return select_value(dbs[0], relation, distinct=distinct, word_frequency=word_frequency)


def arithmetic(op: str, x: int) -> Column:
    """The new value; results stay within 0 and 2**32 - 1.  The constant is an integer from 0."""
    if isinstance(x, bool) or not isinstance(x, int) or x < 0:
        raise ValueError(f"{op} needs an integer from 0")
    v, c = F.col("value"), F.lit(x).cast("long")
    if op == "increase":
        return saturate(v + c)
    if op == "decrease":
        return F.greatest(v - c, F.lit(0).cast("long"))
    if op == "multiply":
        return F.least(v.cast("decimal(20,0)") * c.cast("decimal(18,0)"), F.lit(U32_MAX).cast("decimal(20,0)")).cast("long")
    if op == "divide":
        return F.expr(f"value div {x}") if x else F.lit(0).cast("long")
    if op == "divide-round":
        return F.when(v < c, F.lit(1)).otherwise(F.round(v / c)).cast("long") if x else F.lit(0).cast("long")
    if op == "modulo":
        return v % c if x else F.lit(0).cast("long")
    raise ValueError(f"unknown operation {op}")


def change_value(db: DataFrame, op: str, x: int) -> DataFrame:
    return present(db.withColumn("value", arithmetic(op, x)))
