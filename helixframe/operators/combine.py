"""Combining any number of k-mer datasets: one tagged union and one group-by, whatever their number.

Rules that partial aggregation can express (union, intersection and their minima, maxima and sums,
subtract, differences) use it.  Rules that depend on the order of inputs, and selectors over them,
see the active list: an array of (idx, value, label) of the inputs that hold the k-mer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import U32_MAX, base_count, keys_of, saturate
from ..sources.stored import metas_of, tagged_stored


def tagged(dbs: list[DataFrame]) -> DataFrame:
    """(kmer or packed keys, idx, value, label) of all inputs; idx counts from 0, and a missing label is 0."""
    out = None
    for i, db in enumerate(dbs):
        label = F.col("label") if "label" in db.columns else F.lit(0).cast("long")
        part = db.select(*keys_of(db), F.lit(i).alias("idx"), "value", label.alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def _least() -> Column:
    return F.min_by("value", "idx")


SET_OPERATIONS = ("union", "union-min", "union-max", "union-sum", "intersect", "intersect-min", "intersect-max", "intersect-sum", "subtract", "difference", "symmetric-difference")


def combine(op: str, *dbs: DataFrame) -> DataFrame:
    """(kmer, value[, label]) of a set operation over datasets with unique k-mers; an input may be given twice.

    Where an input has labels, so has the result: unions or them, intersections and them, minima and
    maxima take that of the value they pick (of several the first), subtract takes the first input's
    bits that no other input has, and the differences take the first input's.
    """
    return _combined(op, tagged(list(dbs)), len(dbs), any("label" in db.columns for db in dbs))


def combine_stored(spark: SparkSession, op: str, *paths: str) -> DataFrame:
    """combine() of stored datasets, with packed keys.  Their k and strand have to agree; with as many buckets each, nothing is shuffled."""
    return _combined(op, tagged_stored(spark, *paths), len(paths), any(m.label_bits for m in metas_of(spark, paths)))


def active_stored(spark: SparkSession, *paths: str) -> DataFrame:
    """active() of stored datasets, with packed keys."""
    return _active(tagged_stored(spark, *paths))


def _combined(op: str, rows: DataFrame, n: int, labelled: bool) -> DataFrame:
    keys = keys_of(rows)
    t = rows.groupBy(keys)
    count = F.count(F.lit(1)).alias("_n")
    kind, _, rule = op.partition("-")
    first = F.min_by("label", "idx")
    if kind in ("union", "intersect") and rule in ("", "min", "max", "sum"):
        value = {"": F.count(F.lit(1)) if kind == "union" else _least(), "min": F.min("value"), "max": F.max("value"), "sum": saturate(F.sum("value"))}[rule]
        every = F.bit_or("label") if kind == "union" else F.bit_and("label")
        label = {"min": F.min_by("label", F.struct("value", "idx")), "max": F.min_by("label", F.struct(-F.col("value"), "idx"))}.get(rule, every)
        out = t.agg(value.alias("value"), label.alias("label"), count)
        out = out.where(F.col("_n") == n) if kind == "intersect" else out
    elif op == "subtract":
        own, others = F.bit_or(F.when(F.col("idx") == 0, F.col("label"))), F.bit_or(F.when(F.col("idx") > 0, F.col("label")))
        label = own.bitwiseAND(F.bitwise_not(F.coalesce(others, F.lit(0).cast("long"))))
        out = t.agg(F.sum(F.when(F.col("idx") == 0, F.col("value")).otherwise(-F.col("value"))).alias("value"), label.alias("label"), F.min("idx").alias("_n")).where("_n = 0")
    elif op == "difference":
        out = t.agg(_least().alias("value"), first.alias("label"), count, F.min("idx").alias("_i")).where("_n = 1 and _i = 0")
    elif op == "symmetric-difference":
        out = t.agg(_least().alias("value"), first.alias("label"), count).where("_n = 1")
    else:
        raise ValueError(f"unknown operation {op}")
    labels = ["label"] if labelled else []
    return out.where("value > 0").select(*keys, F.col("value").cast("long").alias("value"), *labels)


def union_multiset(*dbs: DataFrame) -> DataFrame:
    """Union of multisets: rows with equal k-mer and value are one."""
    return tagged(list(dbs)).groupBy(*keys_of(dbs[0]), "value").agg(F.bit_or("label").alias("label"))


def active(*dbs: DataFrame) -> DataFrame:
    """(kmer, a): the active list, in input order.  It holds at most one entry an input."""
    return _active(tagged(list(dbs)))


def _active(rows: DataFrame) -> DataFrame:
    return rows.groupBy(keys_of(rows)).agg(F.array_sort(F.collect_list(F.struct("idx", "value", "label"))).alias("a"))


_FLIP = "-9223372036854775808L"
#: How an input is picked by its value or its label: the least comes first, of several the first input.
_PICKS = {
    "value": {"first": "0", "min": "x.value", "max": "-x.value"},
    "label": {"first": "0", "min": f"x.label ^ {_FLIP}", "max": f"~(x.label ^ {_FLIP})", "lightest": "bit_count(x.label)", "heaviest": "-bit_count(x.label)"},
}


def selected(what: str, rule: str) -> Column:
    """The value of the input that a label rule picks, or the label of that which a value rule picks.

    Rules that pick no input, such as sums, leave the first.
    """
    by = {"value": "label", "label": "value"}[what]
    order = _PICKS[by].get(rule, "0")
    return F.expr(f"array_min(transform(a, (x, i) -> named_struct('o', {order}, 'i', i, 'x', x.{what}))).x")


def _rest() -> str:
    return "slice(a, 2, size(a))"


def assign_value(rule: str, c: int | None = None) -> Column:
    """The output value from the active list by a rule; c is the rule's constant, by default its identity."""
    top = f"{U32_MAX}L"
    cap = lambda x: f"cast(least({x}, {U32_MAX}) as bigint)"
    e = {
        "set": lambda: f"{c}L",
        "at": lambda: f"get(filter(a, x -> x.idx = {(c or 1) - 1}), 0).value",
        "first": lambda: "a[0].value",
        "count": lambda: "cast(size(a) as bigint)",
        "min": lambda: f"least(array_min(transform(a, x -> x.value)), {top if c is None else f'{c}L'})",
        "max": lambda: f"greatest(array_max(transform(a, x -> x.value)), {c or 0}L)",
        "add": lambda: cap(f"aggregate(a, {c or 0}L, (s, x) -> s + x.value)"),
        "sub": lambda: f"greatest(aggregate({_rest()}, a[0].value, (s, x) -> greatest(s - x.value, 0L)) - {c or 0}L, 0L)",
        "mul": lambda: f"aggregate(a, least({1 if c is None else c}L, {top}), (s, x) -> cast(least(cast(s as decimal(18,0)) * cast(x.value as decimal(18,0)), {U32_MAX}) as bigint))",
        "div": lambda: f"aggregate(array_append(transform({_rest()}, x -> x.value), {1 if c is None else c}L), a[0].value, (s, x) -> case when x = 0 then 0L else s div x end)",
        "divzero": lambda: f"aggregate(array_append(transform({_rest()}, x -> x.value), {1 if c is None else c}L), a[0].value, (s, x) -> case when x = 0 then 0L when s < x then 1L else cast(round(s / x) as bigint) end)",
        "mod": lambda: f"aggregate({'transform(' + _rest() + ', x -> x.value)' if c is None else 'array_append(transform(' + _rest() + f', x -> x.value), {c}L)'}, named_struct('q', a[0].value, 'r', 0L), (s, x) -> named_struct('q', case when x = 0 then 0L else s.q div x end, 'r', s.r + case when x = 0 then s.q else s.q % x end), s -> s.r)",
    }[{"dif": "sub", "sum": "add", "rem": "mod"}.get(rule, rule)]
    return F.expr(e())


def assign_label(rule: str, c: int | None = None, width: int = 64) -> Column:
    """The output label from the active list by a rule; labels are ``width`` bits, compared without sign."""
    ones = -1 if width == 64 else (1 << width) - 1
    flip = _FLIP
    least = lambda order: f"array_min(transform(L, (x, i) -> named_struct('o', {order}, 'i', i, 'l', x))).l"
    with_c = lambda d: f"array_append(L, {d if c is None else c}L)"
    labels = "transform(a, x -> x.label)"
    n = 1 if c is None else c
    body = {
        "set": lambda: f"{c}L",
        "at": lambda: f"get(filter(a, x -> x.idx = {(c or 1) - 1}), 0).label",
        "first": lambda: "a[0].label",
        "min": lambda: least(f"x ^ {flip}") if c is None else least(f"x ^ {flip}").replace("(L,", f"({with_c(0)},"),
        "max": lambda: f"array_max(transform({with_c(0)}, x -> x ^ {flip})) ^ {flip}",
        "and": lambda: f"aggregate(L, {ones if c is None else c}L, (s, x) -> s & x)",
        "or": lambda: f"aggregate(L, {c or 0}L, (s, x) -> s | x)",
        "xor": lambda: f"aggregate(L, {c or 0}L, (s, x) -> s ^ x)",
        "difference": lambda: f"aggregate(slice(L, 2, size(L)), L[0] & ~{c or 0}L, (s, x) -> s & ~x)",
        "lightest": lambda: least("bit_count(x)").replace("(L,", f"({with_c(ones)},"),
        "heaviest": lambda: least("-bit_count(x)").replace("(L,", f"({with_c(0)},"),
        "invert": lambda: f"~L[0] & {ones}L",
        "shift-left": lambda: f"shiftleft(L[0], {n}) & {ones}L",
        "shift-right": lambda: f"shiftrightunsigned(L[0], {n})",
        "rotate-left": lambda: f"(shiftleft(L[0], {n % width}) | shiftrightunsigned(L[0], {(width - n) % width})) & {ones}L",
        "rotate-right": lambda: f"(shiftrightunsigned(L[0], {n % width}) | shiftleft(L[0], {(width - n) % width})) & {ones}L",
    }[rule]()
    return F.expr(f"transform(array({labels}), L -> {body})[0]")


def assigned(rows: DataFrame, value: Column, label: Column | None = None, where: Column | None = None) -> DataFrame:
    """(kmer, value[, label]) from active lists; where sees a, value and label."""
    out = rows.withColumn("value", value).withColumn("label", label if label is not None else F.lit(0).cast("long"))
    out = out.where("value > 0")
    out = out.where(where) if where is not None else out
    return out.select(*keys_of(out), "value", *(["label"] if label is not None else []))


def input_value(n: int) -> Column:
    """The value in the n-th input, counting from 1; null if it doesn't hold the k-mer."""
    return F.get(F.filter("a", lambda x: x["idx"] == n - 1), F.lit(0))["value"]


def input_label(n: int) -> Column:
    return F.get(F.filter("a", lambda x: x["idx"] == n - 1), F.lit(0))["label"]


def holds(predicate: Column, negate: bool = False) -> Column:
    """A predicate over inputs: false where an input is missing, negated or not."""
    return F.coalesce(~predicate if negate else predicate, F.lit(False))


def unsigned(c: Column) -> Column:
    """For comparing labels without sign."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def label_test(test: str, c: int, label: Column | str = "label") -> Column:
    """Whether a label has all, any or none of the bits of c, or no others (only)."""
    x, bits = (F.col(label) if isinstance(label, str) else label), F.lit(c).cast("long")
    both = x.bitwiseAND(bits)
    return {"all": both == bits, "any": both != 0, "none": both == 0, "only": x.bitwiseOR(bits) == bits}[test]


def _mask(bits: str, of: str) -> int:
    """The bits of a string, the highest first, whose letters are among those given; as a long."""
    n = sum(1 << i for i, x in enumerate(reversed(bits)) if x in of)
    return n - (1 << 64) if n >= 1 << 63 else n


def label_function(functions: str, label: Column | str = "label", width: int | None = None) -> Column:
    """The label after a function of each of its bits, the highest first: ``0`` clears it, ``1`` sets it, ``+`` keeps it, ``-`` turns it round.

    Bits above the string stay as they are, within the label's width, if that is given.
    """
    if not re.fullmatch(r"[01+-]{1,64}", functions):
        raise ValueError("a label function is up to 64 of 0, 1, + and -")
    x = F.col(label) if isinstance(label, str) else label
    out = x.bitwiseAND(F.lit(~_mask(functions, "01"))).bitwiseOR(F.lit(_mask(functions, "1"))).bitwiseXOR(F.lit(_mask(functions, "-")))
    return out if width in (None, 64) else out.bitwiseAND(F.lit((1 << width) - 1))


def label_bits_test(tests: str, label: Column | str = "label") -> Column:
    """Whether a label passes a test of each of its bits, the highest first.

    ``T`` needs the bit set and ``F`` clear; of the bits with ``t`` one has to be set at least, of
    those with ``f`` one clear; ``x`` and bits above the string aren't looked at.
    """
    if not re.fullmatch(r"[TtFfx]{1,64}", tests):
        raise ValueError("a label test is up to 64 of T, t, F, f and x")
    x = F.col(label) if isinstance(label, str) else label
    every, must = _mask(tests, "TF"), _mask(tests, "T")
    out = x.bitwiseAND(F.lit(every)) == F.lit(must)
    if some := _mask(tests, "t"):
        out = out & (x.bitwiseAND(F.lit(some)) != 0)
    if some := _mask(tests, "f"):
        out = out & (x.bitwiseAND(F.lit(some)) != F.lit(some))
    return out


def label_selector(spec: str, label: Column | str = "label") -> Column:
    """A selector ``functions:tests`` over the bits of a label, which itself stays as it is.

    tests may be all (T for each bit), any (t) or none (F), and is all by default; functions is ``+``
    for each bit by default.  Only 0 and 1 mean the label that is so, and with dots for bits that
    don't matter, one that ends so.
    """
    if re.fullmatch(r"[01.]{1,64}", spec):
        x = F.col(label) if isinstance(label, str) else label
        every = _mask(spec, "01") if "." in spec else -1
        return x.bitwiseAND(F.lit(every)) == F.lit(_mask(spec, "1"))
    functions, _, tests = spec.partition(":")
    alias = {"all": "T", "any": "t", "none": "F", "": "T"}.get(tests)
    if alias and not functions:
        raise ValueError("a label selector needs functions or tests of bits")
    tests = alias * len(functions) if alias else tests
    functions = functions or "+" * len(tests)
    if len(functions) != len(tests):
        raise ValueError("a label selector has as many functions as tests")
    return label_bits_test(tests, label_function(functions, label))


def in_inputs(n: int) -> Column:
    return F.size("a") == n


def between_inputs(n: int, m: int) -> Column:
    return F.size("a").between(n, m)


def in_all_of(*inputs: int) -> Column:
    """Present in each of these inputs, counted from 1."""
    out = F.lit(True)
    for n in inputs:
        out = out & F.expr(f"exists(a, x -> x.idx = {n - 1})")
    return out


def only_in_first() -> Column:
    return (F.size("a") == 1) & in_all_of(1)


def bases(letters: str) -> Column:
    return base_count("kmer", letters)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kmer, value1, value2) where the two differ; a value is null where a k-mer is missing."""
    t = tagged([a, b]).groupBy(keys_of(a)).agg(*[F.max(F.when(F.col("idx") == i, F.col("value"))).alias(f"value{i + 1}") for i in (0, 1)])
    return t.where(~F.col("value1").eqNullSafe(F.col("value2")))
