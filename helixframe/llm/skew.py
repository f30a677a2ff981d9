"""Joins and components that no frequent key can pile up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

LEAST_HOT = 1000  # rows of a key that always may meet in one task
MOST_HOT = 512  # keys that may count as hot


def hot_from(n: int) -> int:
    """From how many rows on a key of n rows in all is hot: fewer than MOST_HOT keys are, whatever n, so that they may be broadcast."""
    return max(LEAST_HOT, -(-n // MOST_HOT))


def looked_up(rows: DataFrame, keys: list[str], table: DataFrame, hot: int, how: str = "inner") -> DataFrame:
    """rows joined with the table (keys, n, ...), which has one row a key and in n how many of the rows have that key.

    Keys of at least ``hot`` rows, of which there are few (see hot_from), are broadcast; only the
    rows of the others are shuffled.  how is inner or left; n isn't returned.
    """
    values = [c for c in table.columns if c not in (*keys, "n")]
    marked = rows.join(F.broadcast(table.where(F.col("n") >= hot).select(*keys, *values, F.lit(True).alias("_hot"))), keys, "left")
    cold = marked.where("_hot is null").drop("_hot", *values).join(table.where(F.col("n") < hot).drop("n"), keys, how)
    return marked.where("_hot").drop("_hot").unionByName(cold)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node is either a centre or has one link to a centre."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    mixed = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or (up = 1 and least = 0)")
    return mixed.agg(F.count(F.lit(1))).first()[0] == 0


def alternating_stars(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), by alternating large-star and small-star steps; root is the smallest node reached.

    Large-star: each node links its larger neighbours to its least neighbour (or itself).  Small-star:
    it links its smaller neighbours and itself to the least of them.  The steps end when all links
    make stars around their least nodes, after a number of rounds logarithmic in the nodes.
    The neighbours of a node are never brought together: only their least is, by partial sums.
    """
    edges = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(edges):
        hot = hot_from(2 * edges.count())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = looked_up(both.where("b > a"), ["a"], least, hot).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.table(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = looked_up(large, ["a"], least, hot).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, scratch.table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(old)
        scratch.drop(large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
