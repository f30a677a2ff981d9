"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into BLOCKS permuted blocks by the hash of their id.  A source's
quota is the number of blocks that it gives, whole rounds over its blocks and then part of a round.
A binary tree over the output shards splits the vector of quotas: at each node the left half's share
of every source is drawn without replacement (multivariate hypergeometric, source by source), so the
leaves' quotas add up exactly and every shard's mixture varies as if all blocks had been shuffled.
Shards then draw disjoint runs of each source's permuted blocks, which are their leaves' quotas long:
a copy of a document is drawn by the shard in whose run its block lies, and by none beyond the last
run.  What a document gives to the mix is the sum of these draws.  write_mix() writes the shards,
each shuffled locally: ordered by a hash of the copy.

DataFrame and SQL functions only.  Until they are written, documents aren't shuffled: they meet one
row for each source, with its runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

HEX = 3  # hexadecimal digits of a block's number
BLOCKS = 16**HEX
MOST_SOURCES = 10_000  # up to so many rows of a few hundred bytes are broadcast


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _log_factorial(x: str) -> str:
    table = ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(20))
    series = f"(({x}) + 0.5D) * ln(cast({x} as double)) - ({x}) + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12D * ({x})) - 1 / (360D * pow({x}, 3)) + 1 / (1260D * pow({x}, 5))"
    return f"(case when ({x}) < 20 then element_at(array({table}), cast(({x}) as int) + 1) else {series} end)"


def hypergeometric(u: str, k: str, total: str, n: str) -> str:
    """SQL for the number of k marked items among n drawn from total, by inversion of the uniform u.

    The probabilities within nine standard deviations of the mode are summed; what lies beyond is
    under 1e-15.
    """
    log_p = "-" + " - ".join(_log_factorial(x) for x in ("x", "p.k - x", "p.n - x", "p.t - p.k - p.n + x"))
    mode = "cast(floor((p.n + 1D) * (p.k + 1D) / (p.t + 2D)) as bigint)"
    sd = "sqrt(greatest(0D, cast(p.n as double) * p.k / greatest(p.t, 1) * (p.t - p.k) / greatest(p.t, 1) * (p.t - p.n) / greatest(p.t - 1, 1)))"
    lo, hi = "greatest(0L, p.n - (p.t - p.k))", "least(p.k, p.n)"
    wide = f"cast(ceil(9 * {sd}) as bigint) + 10"
    span = f"named_struct('a', greatest({lo}, {mode} - ({wide})), 'b', least({hi}, {mode} + {wide}))"
    logs = f"transform(sequence(s.a, s.b), x -> {log_p})"
    weights = "transform(l, x -> exp(x - array_max(l)))"
    pick = "aggregate(w, named_struct('acc', 0D, 'i', 0L), (z, y) -> named_struct('acc', z.acc + y, 'i', if(z.acc + y <= p.u * sums, z.i + 1, z.i)), z -> z.i)"
    body = _let("s", span, _let("l", logs, _let("w", weights, _let("sums", "aggregate(w, 0D, (z, y) -> z + y)", f"least(s.b, s.a + {pick})"))))
    return _let("p", f"named_struct('u', {u}, 'k', {k}, 't', {total}, 'n', {n})", body)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, q) from one row with the array q: q of the shards add up to it, and their sizes differ by one at most."""
    level = quotas.select(F.lit(0).alias("node"), F.col("q").cast("array<bigint>").alias("q"))
    for depth in range(shards.bit_length() - 1):
        u = f"(shiftrightunsigned(xxhash64({seed}, {depth}, node, i), 11) / 9007199254740992D)"
        k = hypergeometric(u, "q[i]", "z.t", "z.n")
        draw = _let("d", k, "named_struct('t', z.t - q[i], 'n', z.n - d, 'out', array_append(z.out, d))")
        start = "named_struct('t', total, 'n', total div 2, 'out', cast(array() as array<bigint>))"
        level = level.withColumn("total", F.expr("aggregate(q, 0L, (z, x) -> z + x)"))
        level = level.withColumn("left", F.expr(f"case when size(q) = 0 then q else aggregate(sequence(0, size(q) - 1), {start}, (z, i) -> {draw}, z -> z.out) end"))
        level = level.select(
            F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")))).alias("x")
        ).select("x.*")
    return level.select(F.col("node").alias("shard"), "q")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size).

    Sources by code point, null last, have the weights in turn and share the sum of all sizes.  A
    target stops at ``most`` times its source's size; the excess goes to the others by weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("place", place).withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * most)
    w = Window.orderBy((F.col("cap") / F.col("w")), "place")
    all_of, before, after = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("rest", F.sum("source_size").over(all_of) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("share", F.sum("w").over(after))
    s = s.withColumn("open", F.col("rest") * F.col("w") <= F.col("cap") * F.col("share"))
    ranked = s.withColumn("i", F.row_number().over(w)).withColumn("at", F.when(F.col("open"), F.struct("i", "rest", "share")))
    first = F.min("at").over(all_of)
    ranked = ranked.withColumn("first", first)
    free = (F.col("w") * F.col("first.rest")).cast("double") / F.col("first.share")
    return ranked.select("source", "source_size", "place", F.when(F.col("first").isNotNull() & (F.col("i") >= F.col("first.i")), free).otherwise(F.col("cap").cast("double")).alias("target"))


def _plan(scratch: Scratch, sized: DataFrame, weights: tuple[int, ...], most: int, shards: int, seed: int) -> DataFrame:
    """One row a source: source, source_size, place, target, rounds and rest of its quota, cut (the block in which the last round ends, and the words before it) and ends (of the shards' runs of blocks)."""
    by_block = scratch.table(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    sizes = by_block.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = targets(sizes, weights, most)
    sources = sources.withColumn("quota", F.round("target").cast("long"))
    sources = sources.withColumn("rounds", F.expr("case when source_size > 0 then quota div source_size else 0 end")).withColumn("rest", F.col("quota") - F.col("rounds") * F.col("source_size"))
    sources = scratch.table(sources, "sources")
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("block"))
    ends = by_block.withColumn("sum", so_far).alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    ends = ends.where("s.rest > 0 and b.sum >= s.rest").groupBy("s.place").agg(F.min(F.struct(F.col("b.block").alias("block"), (F.col("b.sum") - F.col("b.words")).alias("before"))).alias("cut"))
    sources = sources.join(ends, "place", "left").withColumn("blocks", F.col("rounds") * BLOCKS + F.coalesce(F.col("cut.block") + 1, F.lit(0)))
    sources = scratch.table(sources, "quotas")
    tree = split_quotas(sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "blocks"))), lambda x: x["blocks"]).alias("q")), shards, seed)
    leaves = tree.select("shard", F.posexplode("q").alias("place", "n"))
    bounds = leaves.withColumn("end", F.sum("n").over(Window.partitionBy("place").orderBy("shard"))).groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    return scratch.table(sources.join(bounds, "place"), "plan")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, shards: int = 16, seed: int = 1, text: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, draws) for each row of docs (doc_id, text, source, ...).

    size is the number of words (null text: 0).  draws lists the copies that the shards draw: copy,
    output shard, words, and the key that orders the shard; taken is the sum of their words.  Every
    copy but a source's last is whole; the last document of a source's quota gives as many words as
    the quota still lacks, so that each source's taken words equal its rounded target.  A null source
    is a source of its own.  Null or repeated doc_ids are drawn like others.  Documents without words
    give nothing.  Other columns are ignored, an empty table gives an empty result.  shards is a power
    of two.  The same rows and seed give the same mix.  text adds the texts.

    There is a row for each source with an array of its shards, and one row with a number for each
    source at every node of the tree; so it is meant for sources and shards in thousands, not millions.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    more = ["text"] if text else []
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"), *more)
    sized = scratch.table(sized, "sized").withColumn("block", F.conv(F.substring("key", 1, HEX), 16, 10).cast("long"))
    plan = _plan(scratch, sized, weights, most, shards, seed).withColumnRenamed("source", "of")
    if plan.count() <= MOST_SOURCES:
        plan = F.broadcast(plan)
    d = sized.join(plan, sized["source"].eqNullSafe(plan["of"])).drop("of")
    border = F.col("cut").isNotNull() & (F.col("block") == F.col("cut.block"))
    inner = d.where(~border).withColumn("last", F.col("size"))
    w = Window.partitionBy("place").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("cut.before") - F.coalesce(F.sum("size").over(w), F.lit(0))
    outer = d.where(border).withColumn("last", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    # each copy has a place in the source's sequence of permuted blocks, which lies in the run of one shard or behind all
    drawn = """filter(transform(sequence(0L, rounds), c -> named_struct(
        'copy', cast(c as int), 'shard', size(filter(ends, e -> e <= c * {blocks} + block)), 'words', if(c = rounds, last, size), 'order', xxhash64(key, c, {seed}))),
        x -> x.shard < {shards} and x.words > 0)""".format(blocks=BLOCKS, seed=seed, shards=shards)
    d = inner.unionByName(outer).withColumn("draws", F.expr(drawn))
    return d.select("doc_id", "source", "size", "source_size", "target", F.expr("aggregate(draws, 0L, (n, x) -> n + x.words)").alias("taken"), "draws", *more)


def write_mix(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Writes the mix of docs (doc_id, text, source, ...) as Parquet: a folder ``shard=n`` for each shard, with (doc_id, source, copy, words, text) in shuffled order.

    Rows are written as often as they are drawn, those with null or repeated doc_ids, too.  A copy
    that the mix takes in part has that many of its first words, joined by one space.  A shard's files
    are ranges of its order, made by as many tasks as there are shuffle partitions.
    """
    drawn = mix_sources(docs, shards=shards, text=True, **options).select("doc_id", "source", "text", F.explode("draws").alias("x")).select("doc_id", "source", "text", "x.*")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(F.col("words") < F.size(words), F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("text"))
    out = drawn.select("shard", "doc_id", "source", "copy", "words", text.alias("text"), "order")
    out.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order", "doc_id").drop("order").write.partitionBy("shard").parquet(path)
