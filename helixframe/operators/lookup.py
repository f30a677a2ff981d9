"""Looking up the k-mers of sequences in datasets: equi-joins on the packed k-mer.

Sequences are (ident, bases, ...) and, where records are told apart by their place, seq_idx: the
number of the record, as the readers give it.  Then names may repeat or be missing, and results carry
seq_idx, too; without it, names have to be unique.

Catalyst picks the join: a dataset under the broadcast threshold is sent out, a larger one is
shuffled, and skewed k-mers are split at run time.  A sieve (see functions.sieve) keeps windows that no
dataset holds from being shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical, key_columns, packed, packed_windows, unpacked

SPAN = 1 << 20  # positions of a sequence that one task looks at together


def ids_of(df: DataFrame) -> list[str]:
    """The columns that name a record; the first alone tells records apart."""
    return [c for c in ("seq_idx", "ident") if c in df.columns]


def hits(sequences: DataFrame, k: int, *dbs: DataFrame, canonical_db: bool = True, least: int | None = None, most: int | None = None, skip: int = 0, sieve=None) -> DataFrame:
    """([seq_idx,] ident, pos, db, value): k-mers of the sequences that the datasets hold, db counting from 0.

    A canonical dataset is probed once; another one by both strands, and the values of both are
    summed (a palindrome counts once).  least and most bound the values that count.
    """
    ids, keys = ids_of(sequences), key_columns(k)
    w = packed_windows(sequences, k, *ids, strand="canonical" if canonical_db else "both", sieve=sieve)
    w = w.where(F.col("pos") >= skip) if skip else w
    keep = None
    for i, db in enumerate(dbs):
        part = packed(db, k).select(*keys, "value", F.lit(i).alias("db"))
        part = part.where(F.col("value") >= least) if least is not None else part
        part = part.where(F.col("value") <= most) if most is not None else part
        keep = part if keep is None else keep.unionByName(part)
    found = w.join(keep, keys).select(*ids, "pos", "db", "value")
    return found if canonical_db else found.groupBy(*ids, "pos", "db").agg(F.sum("value").alias("value"))


def bed(found: DataFrame, k: int, labels: list[str] | None = None) -> DataFrame:
    """([seq_idx,] ident, begin, end[, label]): with labels a row for each dataset that holds a position, else one a position."""
    ids = ids_of(found)
    if labels is None:
        return found.select(*ids, F.col("pos").alias("begin"), (F.col("pos") + k).alias("end")).distinct()
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("db") + 1)
    return found.select(*ids, F.col("pos").alias("begin"), (F.col("pos") + k).alias("end"), name.alias("label"))


def bed_runs(found: DataFrame, k: int, legacy_end: bool = False, span: int = SPAN) -> DataFrame:
    """([seq_idx,] ident, db, begin, end) of maximal runs of consecutive positions; legacy_end adds one base.

    Runs are found within spans of positions, so that a long sequence is spread out; only those that
    touch a span's border are then looked at together.
    """
    block = F.floor(F.col("pos") / span)
    ids = ids_of(found)
    w = Window.partitionBy(ids[0], "db", "b").orderBy("pos")
    islands = found.select(*ids, "db", "pos", block.alias("b")).distinct().withColumn("g", F.col("pos") - F.row_number().over(w))
    islands = islands.groupBy(*ids, "db", "b", "g").agg(F.min("pos").alias("begin"), F.max("pos").alias("last")).drop("b", "g")
    border = (F.col("begin") % span == 0) | ((F.col("last") + 1) % span == 0)
    by = Window.partitionBy(ids[0], "db").orderBy("begin")
    joined = islands.where(border).withColumn("new", F.coalesce(F.lag("last").over(by) + 1 < F.col("begin"), F.lit(True)).cast("int"))
    joined = joined.withColumn("g", F.sum("new").over(by)).groupBy(*ids, "db", "g").agg(F.min("begin").alias("begin"), F.max("last").alias("last")).drop("g")
    return islands.where(~border).unionByName(joined).select(*ids, "db", "begin", (F.col("last") + k + int(legacy_end)).alias("end"))


def wig_count(found: DataFrame) -> DataFrame:
    """([seq_idx,] ident, pos from 1, value): the sum of values at each position that has any."""
    return found.groupBy(*ids_of(found), (F.col("pos") + 1).alias("pos")).agg(F.sum("value").alias("value"))


def wig_depth(found: DataFrame, k: int, span: int = SPAN) -> DataFrame:
    """([seq_idx,] ident, pos from 1, value): how many k-mers that are found cover a base.

    Each k-mer is a step up and a step down, in each span of positions that it touches; depths are
    running sums of the steps within a span.
    """
    ids = ids_of(found)
    each = found.select(*ids, "pos").distinct()
    at = each.select(*ids, "pos", F.explode(F.sequence(F.floor(F.col("pos") / span), F.floor((F.col("pos") + k - 1) / span))).alias("b"))
    up = F.struct(F.greatest("pos", F.col("b") * span).alias("p"), F.lit(1).alias("d"))
    down = F.struct(F.least(F.col("pos") + k, (F.col("b") + 1) * span).alias("p"), F.lit(-1).alias("d"))
    steps = at.select(*ids, "b", F.explode(F.array(up, down)).alias("x")).groupBy(*ids, "b", F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(ids[0], "b").orderBy("p")
    depths = steps.select(*ids, "p", F.lead("p").over(w).alias("to"), F.sum("d").over(w).alias("value")).where("value > 0 and to is not null")
    return depths.select(*ids, F.explode(F.sequence(F.col("p") + 1, F.col("to"))).alias("pos"), "value")


def existence(sequences: DataFrame, k: int, *dbs: DataFrame, canonical_db: bool = True, sieve=None) -> DataFrame:
    """([seq_idx,] ident, n_kmers, db, db_kmers, found) for each sequence and dataset, db counting from 0; repeats count.

    The datasets become one, with a bit for each that holds a k-mer; windows meet it once.  Of
    datasets that aren't canonical, k-mers of either strand count.
    """
    ids, keys, n = ids_of(sequences), key_columns(k), len(dbs)
    if n > 63:
        raise ValueError("existence takes up to 63 datasets")
    every = None
    for i, db in enumerate(dbs):
        part = packed(db, k) if canonical_db else packed(unpacked(db, k).withColumn("kmer", canonical("kmer")), k)
        part = part.select(*keys, F.lit(1 << i).alias("bit"), F.lit(1).alias("one"))
        every = part if every is None else every.unionByName(part)
    # a k-mer comes up to twice from one dataset, if that holds both strands
    every = every.groupBy(keys).agg(F.bit_or("bit").cast("long").alias("bits"), *[F.count_if(F.col("bit") == 1 << i).alias(f"n{i}") for i in range(n)])
    sizes = every.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(n)])  # one row
    sizes = sizes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("db"), F.col(f"n{i}").alias("db_kmers")) for i in range(n)])).alias("x")).select("x.*")
    bit = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
    key = ids[0]
    found = packed_windows(sequences, k, key, sieve=sieve).join(every.select(*keys, "bits"), keys).groupBy(key).agg(*[F.count_if(bit(i)).alias(f"f{i}") for i in range(n)])
    found = sequences.select(*ids, _n_windows(k).alias("n_kmers")).join(found, key, "left")
    zero = F.lit(0).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("db"), F.coalesce(f"f{i}", zero).alias("found")) for i in range(n)]))
    out = found.select(*ids, "n_kmers", each.alias("x")).select(*ids, "n_kmers", "x.db", "x.found").join(F.broadcast(sizes), "db")  # a row for each dataset given
    return out.select(*ids, "n_kmers", "db", "db_kmers", "found")


def _n_windows(k: int) -> Column:
    """How many k-mers of ``bases`` span no other letter than ACGT."""
    return F.coalesce(F.aggregate(F.split("bases", "[^ACGT]+"), F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.length(x) - (k - 1), F.lit(0))), F.lit(0).cast("long"))


def include(sequences: DataFrame, k: int, db: DataFrame, skip: int = 0, exclude: bool = False, mates: DataFrame | None = None, canonical_db: bool = True, sieve=None) -> DataFrame:
    """Sequences with a k-mer in the dataset, and n_kmers found; exclude keeps those without.

    skip leaves out the k-mers that begin before it, in the first of a pair only.  mates pairs by
    seq_idx, or by ident where there is none: a pair stays or goes whole, the second bases are
    returned as mate_bases, and where one side ends first, the other goes on alone.
    """
    key = ids_of(sequences)[0]
    f = hits(sequences, k, db, skip=skip, canonical_db=canonical_db, sieve=sieve).select(key)
    if mates is not None:
        f = f.unionByName(hits(mates, k, db, canonical_db=canonical_db, sieve=sieve).select(key))
        sequences = sequences.join(mates.select(key, F.col("bases").alias("mate_bases")), key, "full")
    n = f.groupBy(key).agg(F.count(F.lit(1)).alias("n_kmers"))
    if exclude:
        return sequences.join(n, key, "left_anti").withColumn("n_kmers", F.lit(0).cast("long"))
    return sequences.join(n, key)


def reference_hits(reference: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Canonical windows (ref, ref_pos, key) of the reference and (qry, qry_pos, key) of the queries; ref and qry are seq_idx where there is one, else ident."""
    sides = []
    for df, name in ((reference, "ref"), (queries, "qry")):
        w = packed_windows(df, k, ids_of(df)[0])
        sides.append(w.select(F.col(ids_of(df)[0]).alias(name), F.col("pos").alias(f"{name}_pos"), *key_columns(k)))
    return sides[0], sides[1]


def hits_per_query(reference: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """([seq_idx,] ident, length, n_ref, n_hits): reference occurrences of a query's k-mers, and k-mers that have any."""
    r, q = reference_hits(reference, queries, k)
    ids, keys = ids_of(queries), key_columns(k)
    db = r.groupBy(keys).agg(F.count(F.lit(1)).alias("value"))
    per = q.join(db, keys).groupBy("qry").agg(F.sum("value").alias("n_ref"), F.count(F.lit(1)).alias("n_hits"))
    out = queries.select(*ids, F.length("bases").cast("long").alias("length")).join(per, F.col(ids[0]) == F.col("qry"), "left")
    return out.select(*ids, "length", F.coalesce("n_ref", F.lit(0)).cast("long").alias("n_ref"), F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"))


def hit_table(reference: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qry, qry_pos, ref, ref_pos): each place of the queries with each place of the reference that has its k-mer, on either strand."""
    r, q = reference_hits(reference, queries, k)
    return q.join(r, key_columns(k)).select("qry", "qry_pos", "ref", "ref_pos")


def check_report(report: str, inputs: int, datasets: int, labels: int = 0) -> None:
    """Raises ValueError for numbers of inputs, datasets and labels that a report has no use for."""
    if report not in ("bed", "bed-runs", "wig-count", "wig-depth", "existence", "include", "exclude"):
        raise ValueError(f"unknown report {report}")
    if not 1 <= inputs <= (2 if report in ("include", "exclude") else 1):
        raise ValueError(f"{report} needs one input" + (", or a pair" if report in ("include", "exclude") else ""))
    if datasets < 1 or (datasets > 1 and report in ("wig-depth", "include", "exclude")):
        raise ValueError(f"{report} needs one dataset")
    if labels and (report not in ("bed", "bed-runs") or labels != datasets):
        raise ValueError("labels are for BED, one for each dataset")


def report(kind: str, inputs: list[DataFrame], datasets: list[DataFrame], k: int, labels: list[str] | None = None, skip: int = 0, **options) -> DataFrame:
    """The rows of a report (see check_report) of one input, or of a pair for include and exclude; options are those of hits()."""
    check_report(kind, len(inputs), len(datasets), len(labels or ()))
    if kind == "existence":
        return existence(inputs[0], k, *datasets, **options)
    if kind in ("include", "exclude"):
        return include(inputs[0], k, datasets[0], skip, kind == "exclude", inputs[1] if len(inputs) > 1 else None, **options)
    found = hits(inputs[0], k, *datasets, skip=skip, **options)
    return {"bed": lambda: bed(found, k, labels), "bed-runs": lambda: bed_runs(found, k), "wig-count": lambda: wig_count(found), "wig-depth": lambda: wig_depth(found, k)}[kind]()


def mers_per_base(reference: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(ref, ref_pos, n): query k-mers that occur at a reference position.  Both sides are counted before they are joined."""
    r, q = reference_hits(reference, queries, k)
    return r.join(q.groupBy(key_columns(k)).agg(F.count(F.lit(1)).alias("n")), key_columns(k)).select("ref", "ref_pos", "n")


def queries_per_base(reference: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(ref, ref_pos, n): distinct queries with a k-mer at a reference position."""
    r, q = reference_hits(reference, queries, k)
    n = q.select("qry", *key_columns(k)).distinct().groupBy(key_columns(k)).agg(F.count(F.lit(1)).alias("n"))
    return r.join(n, key_columns(k)).select("ref", "ref_pos", "n")


def composition(db: DataFrame, score: Column) -> DataFrame:
    """(score, value, count): k-mers by a score of their bases and their value."""
    return db.select(score.cast("int").alias("score"), "value").groupBy("score", "value").agg(F.count(F.lit(1)).alias("count"))
