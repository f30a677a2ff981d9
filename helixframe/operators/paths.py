"""Paths of a canonical dataset: k-mers chained where the extension is the only one, both ways.

Each k-mer has two ends, each at the k-1 bases that it shares with others.  Of the up to eight ends that
meet at such a junction, four on either side, two are mates if no other end is there.  Mates of
all k-mers make chains, whose ends are found by pointer doubling: in each round an end takes
over what the end that it points to points to, so that the rounds are as many as the longest path has binary
digits.  Each round is a join without frequent keys, as no two ends point to the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, reverse_complement, sort_key, unpacked
from ..sources.stored import new_path

END = ["x", "e"]  # a k-mer and its end: 0 left, 1 right


class _Tables:
    """Tables in the shared folder, each of one round."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, new_path(spark, "paths"), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")


def mates(kmers: DataFrame) -> DataFrame:
    """(x, e, y, f): ends of k-mers that are each other's only extension.  A k-mer isn't its own mate, and junctions that are their own reverse complement have none."""
    ends = kmers.select("x", F.explode(F.array(F.lit(0), F.lit(1))).alias("e"))
    bases = F.when(F.col("e") == 1, F.expr("substring(x, 2)")).otherwise(F.expr("left(x, length(x) - 1)"))
    ends = ends.withColumn("b", bases).withColumn("j", canonical("b")).where(F.col("b") != reverse_complement("b"))
    # a right end comes into a junction that reads as the k-mer does, a left one goes out of it
    at = ends.select("x", "e", "j", ((F.col("b") == F.col("j")) == (F.col("e") == 1)).alias("comes"))
    of = lambda side: F.max(F.when(side, F.struct("x", "e")))
    comes = F.col("comes")
    pairs = at.groupBy("j").agg(F.count_if(comes).alias("n1"), F.count_if(~comes).alias("n2"), of(comes).alias("p"), of(~comes).alias("q")).where("n1 = 1 and n2 = 1 and p.x <> q.x")
    both = F.explode(F.array(F.struct(F.col("p").alias("u"), F.col("q").alias("v")), F.struct(F.col("q").alias("u"), F.col("p").alias("v"))))
    return pairs.select(both.alias("z")).select("z.u.x", "z.u.e", F.col("z.v.x").alias("y"), F.col("z.v.e").alias("f"))


def _doubled(table: _Tables, pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, e, px, pe, d) of ends whose chain has an end, which is (px, pe), d steps away; and (x, e) of those on cycles.

    pointers (x, e, px, pe, d, done): an end and where its chain goes on, or itself, where it ends.
    """
    live, left = table(pointers), None
    done = [live.where("done")]
    while True:
        rest = live.where("not done")
        now = rest.count()
        if now in (0, left):
            return _all(done).drop("done"), rest.select(END)
        left = now
        of = live if len(done) == 1 else _all([*done, rest])
        of = of.select(F.col("x").alias("px"), F.col("e").alias("pe"), F.col("px").alias("qx"), F.col("pe").alias("qe"), F.col("d").alias("more"), F.col("done").alias("ends"))
        live = table(rest.drop("done").join(of, ["px", "pe"]).select("x", "e", F.col("qx").alias("px"), F.col("qe").alias("pe"), (F.col("d") + F.col("more")).alias("d"), F.col("ends").alias("done")))
        done.append(live.where("done"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _pointers(ends: DataFrame, pairs: DataFrame) -> DataFrame:
    """Where each end's chain goes on: beyond its mate, to the other end of that k-mer."""
    out = ends.join(pairs, END, "left")
    there = F.col("y").isNotNull()
    return out.select("x", "e", F.coalesce("y", "x").alias("px"), F.when(there, 1 - F.col("f")).otherwise(F.col("e")).alias("pe"), there.cast("long").alias("d"), (~there).alias("done"))


def _least_on_cycles(table: _Tables, pointers: DataFrame) -> DataFrame:
    """(x): the least k-mer of each cycle."""
    state = table(pointers.select("x", "e", "px", "pe", F.least(sort_key("x"), sort_key("px")).alias("least")))
    while True:
        of = state.select(F.col("x").alias("px"), F.col("e").alias("pe"), F.col("px").alias("qx"), F.col("pe").alias("qe"), F.col("least").alias("other"))
        met = table(state.join(of, ["px", "pe"]))
        if not met.where("other < least").limit(1).count():
            return state.where(F.col("least") == sort_key("x")).select("x").distinct()
        state = met.select("x", "e", F.col("qx").alias("px"), F.col("qe").alias("pe"), F.least("least", "other").alias("least"))


def unique_paths(db: DataFrame, k: int) -> DataFrame:
    """(path, pos, kmer): each k-mer of a canonical dataset (kmer or packed keys, ...) in the one path that it is in, in the direction of the path.

    A path is named by the k-mer where it begins, the lesser of the canonical ones at its two ends, read
    so that it begins there; k-mers are ordered by A < C < T < G.  pos counts from 0; kmer overlaps
    the one before by k - 1 bases.  A cycle is cut before its least k-mer's left end.
    """
    table = _Tables(db.sparkSession)
    kmers = table(unpacked(db, k).select(F.col("kmer").alias("x")).distinct())
    pairs = table(mates(kmers))
    ends = kmers.select("x", F.explode(F.array(F.lit(0), F.lit(1))).alias("e"))
    pointers = table(_pointers(ends, pairs))
    found, cycles = _doubled(table, pointers)
    if cycles.limit(1).count():
        cut = _least_on_cycles(table, pointers.join(cycles, END, "left_semi")).withColumn("e", F.lit(0))
        gone = pairs.join(cut, END, "left_semi")
        gone = gone.select("x", "e").unionByName(gone.select(F.col("y").alias("x"), F.col("f").alias("e")))
        again, _ = _doubled(table, _pointers(cycles, pairs.join(table(gone), END, "left_anti")))
        found = found.unionByName(again)
    far = F.struct("px", "pe", "d")
    both = found.groupBy("x").agg(F.max(F.when(F.col("e") == 0, far)).alias("l"), F.max(F.when(F.col("e") == 1, far)).alias("r"))
    # the path begins at the lesser end; of a path of one k-mer at the left
    left = (sort_key("l.px") < sort_key("r.px")) | ((F.col("l.px") == F.col("r.px")) & (F.col("l.pe") <= F.col("r.pe")))
    begin = F.when(left, F.col("l")).otherwise(F.col("r"))
    placed = both.select(begin["px"].alias("path"), begin["d"].alias("pos"), F.when(left, F.col("x")).otherwise(reverse_complement("x")).alias("kmer"))
    return placed
