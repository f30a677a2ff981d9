"""Prefix trie of conversations, rolled up by pointer jumping.

A node stands for a distinct sequence of first turns and is known by a 128-bit digest: the
exclusive or of a hash of each turn with its position.  Digests of all prefixes are running
aggregates, and a node's parent is its digest without its own last turn, so that edges need no
join.  Leaf counts and savings reach all ancestors in doubling rounds: in round k each node gives
what it has of its descendants nearer than 2**k to its 2**k-th ancestor, and takes its ancestor's
pointer over.  There are as many rounds as the greatest depth has binary digits.

No step brings a conversation, the members of a node or its children into one task: turns are
numbered by ranges, prefixes by chunks, nodes and sums by partial aggregation, and pointers to
frequent nodes are looked up by broadcasting those few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .skew import hot_from, looked_up

CHUNK = 1024  # turns whose running digests one window takes
PACKED = 4096  # members in a row on their way to the hash of a node's ends
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["k1", "k2"]


def _hex(digest: str, at: int):
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def numbered_turns(scratch: Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, pos, h1, h2, words) of each turn of conversations (conv_id, turn, role, text), and (conv_id, part, before, n) of each range of a conversation.

    pos counts from 1 by turn, null first; turns of one number go by their digests.  A null role or
    text is an empty one; turns without conv_id are left out.  n: turns of the conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    ranged = turns.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id())
    ranged = scratch.table(ranged, "ranged")
    parts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("conv_id")
    parts = parts.select("conv_id", "part", (F.sum("m").over(w.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(w).alias("n"))
    parts = scratch.table(parts, "parts")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    turns = ranged.withColumn("place", place).join(parts.select("conv_id", "part", "before"), ["conv_id", "part"])
    turns = turns.select("conv_id", "part", (F.col("place") + F.col("before")).alias("pos"), _hex("digest", 1).alias("h1"), _hex("digest", 16).alias("h2"), "words")
    return scratch.table(turns, "turns"), parts


def grafted(turns: DataFrame, parts: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and parts (see numbered_turns) of conversations that take their beginning from another.

    The first h turns of conversation c become those of c - c % every (fewer, if that has fewer; none,
    if it is absent), where h is the crc32 of c's decimal digits modulo most.
    """
    convs = parts.groupBy("conv_id").agg(F.max("n").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    info = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    info = info.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    info = info.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    info = info.withColumn("n", F.col("k") + F.col("own"))
    moved = parts.drop("n").join(info.drop("base"), "conv_id")
    own = turns.join(moved.select("conv_id", "part", "h", "k", "n"), ["conv_id", "part"]).where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("k"))
    first = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "h1", "h2", "words")
    taken = info.where("k > 0").join(first, "base").where("pos <= k")
    columns = ["conv_id", "pos", "h1", "h2", "words", "n"]
    return own.select(columns).unionByName(taken.select(columns)), info.select("conv_id", "n")


def _prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, pos, h1, h2, words, n) with the digests of the prefix that each ends (k1, k2), and of the one before (p1, p2)."""
    turns = turns.select("conv_id", "pos", "words", "n", F.xxhash64(F.lit(1), "pos", "h1", "h2").alias("g1"), F.xxhash64(F.lit(2), "h2", "h1", "pos").alias("g2"), F.expr(f"(pos - 1) div {CHUNK}").alias("chunk"))
    w = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.select("*", F.bit_xor("g1").over(w).alias("k1"), F.bit_xor("g2").over(w).alias("k2"))
    long = run.where(f"n > {CHUNK}")
    sums = turns.where(f"n > {CHUNK}").groupBy("conv_id", "chunk").agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(s) for s in ("s1", "s2")])
    long = long.join(sums, ["conv_id", "chunk"]).withColumns({"k1": F.col("k1").bitwiseXOR(F.col("s1")), "k2": F.col("k2").bitwiseXOR(F.col("s2"))}).drop("s1", "s2")
    both = run.where(f"n <= {CHUNK}").unionByName(long)
    return both.select("conv_id", F.col("pos").alias("depth"), "words", "k1", "k2", F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("p2"), (F.col("pos") == F.col("n")).alias("last"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (k1, k2, conv_id), sorted, as rows of at most PACKED ids."""
    key, ids, out = None, [], []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "first", "ids"])

    for batch in batches:
        for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (a, b) != key or len(ids) == PACKED:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (a, b), []
                if len(out) == 256:
                    yield rows()
                    out.clear()
            ids.append(c)
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
        yield rows()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's ids, of which the packed rows come in order."""
    key = sha = None
    done: list[tuple[int, int, str]] = []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (a, b) == key:
                sha.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, sha.hexdigest()))
            key, sha = (a, b), hashlib.sha256(ids.encode())
        if done:
            yield rows()
            done.clear()
    if key:
        done.append((*key, sha.hexdigest()))
        yield rows()


def rolled_up(scratch: Scratch, nodes: DataFrame, values: list[str]) -> DataFrame:
    """(k1, k2, values) of nodes (k1, k2, p1, p2, depth, values): each value summed over the node's subtree, by doubling.

    p1 and p2 name the parent, which has to be among the nodes; the root has depth 0.
    """
    columns = [*NODE, "p1", "p2", "depth", *values]
    live, given, step = scratch.table(nodes.where("depth >= 1").select(columns), "live"), [], 1
    n, deepest = nodes.agg(F.count(F.lit(1)), F.max("depth")).first()
    sums = lambda df: df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values])
    while step <= (deepest or 0):
        # live: nodes of depth >= step, with their step-th ancestor and their sums over descendants nearer than step
        gift = scratch.table(sums(live.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))), "gift")
        given.append(gift)
        old, step = live, 2 * step
        if step <= deepest:
            summed = live.join(gift.select(*NODE, "n", *[F.col(v).alias(f"+{v}") for v in values]), NODE, "left")
            summed = scratch.table(summed.select(*NODE, "p1", "p2", "depth", F.coalesce("n", F.lit(0)).alias("n"), *[(F.col(v) + F.coalesce(F.col(f"`+{v}`"), F.lit(0))).alias(v) for v in values]), "summed")
            jump = summed.where("n > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "n")
            rest = summed.where(F.col("depth") >= step).drop("n")
            live = looked_up(rest, ["p1", "p2"], jump, hot_from(n)).select(*NODE, F.col("q1").alias("p1"), F.col("q2").alias("p2"), "depth", *values)
            live = scratch.table(live, "live")
            scratch.drop(summed)
        scratch.drop(old)
    own = nodes.select(*NODE, *values)
    for gift in given:
        own = own.unionByName(gift.drop("n"))
    return own.groupBy(NODE).agg(*[F.sum(v).alias(v) for v in values])


def prefix_trie(scratch: Scratch, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes, from turns (conv_id, pos, h1, h2, words, n) and convs (conv_id, n), n being the turns of the conversation.

    See conversation_trie for the columns.
    """
    paths = scratch.table(_prefixes(turns), "paths")
    one = paths.groupBy(NODE).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    one = scratch.table(one.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "one")
    below = one.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = one.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    nodes = scratch.table(nodes, "nodes")
    sums = rolled_up(scratch, nodes, ["n_leaves", "saved_tokens"])

    ends = paths.where("last").select(*NODE, "conv_id").unionByName(convs.where("n = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    ends = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_packed, "k1 long, k2 long, first long, ids string")
    ends = scratch.table(ends, "ends").repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")

    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    plain = nodes.select(*NODE, "p1", "p2", "conv_id", "depth", "n_convs", "n_children")
    n = nodes.count()
    named = looked_up(plain.where("depth > 0"), ["p1", "p2"], parents, hot_from(n)).unionByName(plain.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = named.join(sums, NODE).join(ends, NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, graft: bool = False) -> DataFrame:
    """A row for each distinct sequence of first turns of conversations (conv_id, turn, role, text).

    conv_id: the smallest member; depth: turns; parent_conv_id: the parent's conv_id, null for the
    textless root; n_convs: conversations that begin so; n_children; n_leaves: childless nodes of the
    subtree, itself included; saved_tokens: over the subtree, the words of each node's last turn times
    the members that needn't repeat it; ends_sha256: of the decimal conv_ids that end here, ascending
    and comma-joined.  graft: conversations begin like others first (see grafted).

    Turns are ordered by turn, null first, and by digest within a number; a null role or text is an
    empty one.  Turns without conv_id are left out, repeated rows are turns of their own.  Other
    columns are ignored; a table without conversations has no node.  The hash of one node's ends is
    made by one task, which streams them PACKED a row.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, parts = numbered_turns(scratch, conversations)
    if graft:
        turns, convs = grafted(turns, parts)
    else:
        convs = parts.groupBy("conv_id").agg(F.max("n").alias("n"))
        turns = turns.join(parts.select("conv_id", "part", "n"), ["conv_id", "part"]).drop("part")
    return prefix_trie(scratch, turns, scratch.table(convs, "convs"))
