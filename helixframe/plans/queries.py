"""One query for each operator, over whole tables, and the same in SQL.

There are no sequences among the tables: prose is projected onto bases.  Operations on several
datasets have all documents dealt out by their ids; lookups run the benchmark's sequences against
those of all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, encode, hpc, run_score, sieve, sort_key, unpacked
from ..functions.kmers import canonical_acgt, windows
from ..operators import combine as C
from ..operators import counting, lookup, paths, reports, superkmers, values
from ..sources import datasets, sequences, stored, tracks

K = 9
INPUTS = 3
NAMES = ("one", "two", "three")
WIDTH = 8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, d: str, part: int | None = None, of: int = INPUTS, bases=sequences.broken_bases) -> DataFrame:
    docs = _table(spark, d, "documents")
    few = docs.select("doc_id").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    docs = docs.where(F.col("doc_id") % of == part) if part is not None else docs
    docs = docs.select(F.col("doc_id").alias("ident"), "text")
    # a file may be one split, and its words are many times its rows; with enough splits nothing is shuffled
    return (docs.repartition("ident") if few else docs).select("ident", bases().alias("bases"))


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("ident"), sequences.broken_bases().alias("bases"))


def _db(spark: SparkSession, d: str, part: int | None = None, of: int = INPUTS, **more) -> DataFrame:
    return counting.count_kmers(_docs(spark, d, part, of), k=K, **more)


def _labelled(db: DataFrame, i: int) -> DataFrame:
    return db.withColumn("label", ((F.col("value") * 37 + (i + 1) * 101) % 256).cast("long"))


def _dbs(spark: SparkSession, d: str, labels: bool = False, of: int = INPUTS) -> list[DataFrame]:
    out = [_db(spark, d, i, of) for i in range(of)]
    return [_labelled(x, i) for i, x in enumerate(out)] if labels else out


# SQL pieces

_AL, _DN = sequences.LETTERS, sequences.BASES
_BROKEN = f"regexp_replace(translate(lower(text), '{_AL}', '{_DN}'), '[^ACGT]', 'N', 'g')"
_UNBROKEN = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_AL}', '{_DN}')"


def _sort(x: str) -> str:
    return f"translate({x}, 'ACTG', '0123')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _canon(x: str) -> str:
    return f"CASE WHEN {_sort(x)} <= {_sort(_rc(x))} THEN {x} ELSE {_rc(x)} END"


def _windows(name: str, source: str, k: int = K) -> str:
    """CTEs ending in ``name`` (ident, tag, p, f, kmer), from source (ident, tag, q); chunks keep substr cheap."""
    return f"""{name}_c AS (SELECT ident, tag, b * 500 AS o, substr(q, b * 500 + 1, {500 + k - 1}) AS c FROM (SELECT ident, tag, q, unnest(range(0, (length(q) + 499) // 500)) AS b FROM ({source}))),
{name}_w AS (SELECT ident, tag, o + i - 1 AS p, substr(c, i, {k}) AS f FROM (SELECT ident, tag, o, c, unnest(range(1, least(500, length(c) - {k - 1}) + 1)) AS i FROM {name}_c)),
{name} AS (SELECT ident, tag, p::BIGINT AS p, f, {_canon("f")} AS kmer FROM {name}_w WHERE NOT contains(f, 'N'))"""


def _number_sql(kmer: str, begin: int, n: int) -> str:
    """The number of n bases of a k-mer, two bits a base."""
    return f"list_sum(list_transform(range({begin}, {begin + n}), lambda j: (instr('ACTG', substr({kmer}, j::INT, 1)) - 1)::HUGEINT << (2 * ({begin + n - 1} - j))::INT))"


def _doc_sql(q: str = _BROKEN, where: str = "true", of: int = INPUTS) -> str:
    return f"SELECT doc_id AS ident, doc_id % {of} AS tag, {q} AS q FROM documents WHERE {where}"


_BENCH_SQL = f"SELECT item_id AS ident, NULL AS tag, {_BROKEN} AS q FROM benchmark"
_DB = f"WITH {_windows('w', _doc_sql())},\ndb AS (SELECT kmer, count(*)::BIGINT AS value FROM w GROUP BY kmer)\n"
_COMBINE = f"""WITH {_windows("w", _doc_sql())},
t AS (SELECT kmer, tag::BIGINT AS idx, count(*)::BIGINT AS value FROM w GROUP BY 1, 2),
u AS (SELECT *, (value * 37 + (idx + 1) * 101) % 256 AS label FROM t),
a AS (SELECT kmer, count(*)::BIGINT AS n, list(value ORDER BY idx) AS v, list(label ORDER BY idx) AS l, list(idx ORDER BY idx) AS i,
      min(value) AS least, max(value) AS most, sum(value)::BIGINT AS total FROM u GROUP BY kmer)
"""


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _unary(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda s, d: f(_db(s, d)), _DB + sql)


def _counting() -> None:
    count = "SELECT {0} AS kmer, count(*)::BIGINT AS value FROM w {1} GROUP BY 1"
    base = f"WITH {_windows('w', _doc_sql())}\n"
    _add("count_canonical", lambda s, d: _db(s, d), base + count.format("kmer", ""))
    _add("count_forward", lambda s, d: _db(s, d, strand="forward"), base + count.format("f", ""))
    _add("count_reverse", lambda s, d: _db(s, d, strand="reverse"), base + count.format(_rc("f"), ""))
    squeezed = _BROKEN
    for x in "ACGTN":
        squeezed = f"regexp_replace({squeezed}, '{x}+', '{x}', 'g')"
    _add("count_compress", lambda s, d: _db(s, d, compress=True), f"WITH {_windows('w', _doc_sql(squeezed))}\n" + count.format("kmer", ""))
    _add("count_suffix", lambda s, d: _db(s, d, suffix="ac"), base + count.format("kmer", "WHERE kmer LIKE '%AC'"))
    _add("count_label", lambda s, d: _db(s, d, label=5, value=1), base + "SELECT DISTINCT kmer, 1::BIGINT AS value, 5::BIGINT AS label FROM w")
    both = _doc_sql() + " UNION ALL " + _BENCH_SQL
    _add("count_multi_input", lambda s, d: counting.count_kmers(_docs(s, d), _bench(s, d), k=K), f"WITH {_windows('w', both)}\n" + count.format("kmer", ""))
    long = f"WITH {_windows('w', _doc_sql(_UNBROKEN), 21)}\n" + count.format("kmer", "")
    _add("count_k21", lambda s, d: counting.count_kmers(_docs(s, d, bases=sequences.unbroken_bases), k=21), long)
    _add("count_superkmers", lambda s, d: superkmers.count_superkmers(_docs(s, d, bases=sequences.unbroken_bases), k=21), long)
    split = lambda x: f"{{'hi': {_number_sql(x, 1, 10)} - 9223372036854775808::HUGEINT, 'lo': {_number_sql(x, 11, 32)} - 9223372036854775808::HUGEINT}}"
    two = f"WITH {_windows('w', _doc_sql(_UNBROKEN), 42)}\n" + count.format("kmer", "")
    _add("count_k42", lambda s, d: counting.count_kmers(_docs(s, d, bases=sequences.unbroken_bases), k=42), two)
    _add("count_k42_packed", lambda s, d: counting.count_kmers(_docs(s, d, bases=sequences.unbroken_bases), k=42, keys=True), f"WITH x AS ({two}), y AS (SELECT {split('kmer')} AS z, value FROM x) SELECT z.hi::BIGINT AS code, z.lo::BIGINT AS code2, value FROM y")
    _add("print_actg", lambda s, d: datasets.printed(_db(s, d)), _DB + f"SELECT {_sort('kmer')} AS key, kmer || chr(9) || value AS line FROM db")
    _add("print_acgt", lambda s, d: datasets.printed(_db(s, d), acgt=True), _DB + f"SELECT {_sort('kmer')} AS key, least(kmer, {_rc('kmer')}) || chr(9) || value AS line FROM db")
    _add("print_labels", lambda s, d: datasets.printed(_labelled(_db(s, d), 0)), _DB + f"SELECT {_sort('kmer')} AS key, kmer || chr(9) || value || chr(9) || bin((value * 37 + 101) % 256) AS line FROM db")
    _add("windows_positions", lambda s, d: windows(_bench(s, d), K, "ident"), f"WITH {_windows('w', _BENCH_SQL)}\nSELECT ident, p AS pos, f AS kmer FROM w")
    imported = lambda s, d: windows(_docs(s, d), K, "ident").select(F.lit(0).cast("long").alias("line"), F.col("kmer").alias("word1"), (F.col("pos") % 7 + 1).cast("string").alias("word2"), F.lit(None).cast("string").alias("word3"))
    _add("import_sum", lambda s, d: datasets.import_list(imported(s, d)), base + "SELECT kmer, sum(p % 7 + 1)::BIGINT AS value, 0::BIGINT AS label FROM w GROUP BY 1")
    _add("import_forward", lambda s, d: datasets.import_list(imported(s, d), strand="forward"), base + "SELECT f AS kmer, sum(p % 7 + 1)::BIGINT AS value, 0::BIGINT AS label FROM w GROUP BY 1")
    multi = lambda s, d: datasets.import_list(windows(_bench(s, d), K, "ident").select(F.lit(0).cast("long").alias("line"), F.col("kmer").alias("word1"), F.lit(None).cast("string").alias("word2"), F.lit(None).cast("string").alias("word3")), multiset=True)
    _add("import_multiset", multi, f"WITH {_windows('w', _BENCH_SQL)}\nSELECT kmer, 1::BIGINT AS value, 0::BIGINT AS label FROM w")

    def persistent(s: SparkSession, d: str) -> DataFrame:
        # every fifth line sets the value of those that follow
        lines = _table(s, d, "supplier").select(F.col("s_suppkey").alias("line"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("#"), F.col("s_suppkey").cast("string"))).otherwise(F.translate(F.lpad((F.col("s_suppkey") % 50).cast("string"), 4, "0"), "0123456789", "ACGTACGTAC")).alias("word1"))
        return datasets.import_list(lines.withColumn("word2", F.lit(None).cast("string")).withColumn("word3", F.lit(None).cast("string")))

    _add(
        "import_persistent",
        persistent,
        f"""WITH x AS (SELECT s_suppkey AS n, translate(lpad((s_suppkey % 50)::VARCHAR, 4, '0'), '0123456789', 'ACGTACGTAC') AS f FROM supplier),
y AS (SELECT f, coalesce(max(CASE WHEN n % 5 = 0 THEN n END) OVER (ORDER BY n), 1) AS v, n FROM x)
SELECT {_canon("f")} AS kmer, sum(v)::BIGINT AS value, 0::BIGINT AS label FROM y WHERE n % 5 <> 0 GROUP BY 1""",
    )

    def directives(s: SparkSession, d: str) -> DataFrame:
        # every fourth line sets the value, every fourth the label, and every tenth of the others has its own
        n, none = F.col("o_orderkey"), F.lit(None).cast("string")
        kmer = F.translate(F.lpad((n % 900).cast("string"), 5, "0"), "0123456789", "ACGTACGTAC")
        word1 = F.when(n % 4 == 0, F.concat(F.lit("value="), (n % 50 + 1).cast("string"))).when(n % 4 == 1, F.concat(F.lit("label="), (n % 64).cast("string"))).otherwise(kmer)
        own = (n % 4 > 1) & (n % 10 == 3)
        return datasets.import_list(_table(s, d, "orders").select(n.alias("line"), word1.alias("word1"), F.when(own, F.lit("9")).otherwise(none).alias("word2"), F.when(own, F.lit("128")).otherwise(none).alias("word3")), strand="reverse")

    _add(
        "import_directives",
        directives,
        f"""WITH x AS (SELECT o_orderkey AS n, translate(lpad((o_orderkey % 900)::VARCHAR, 5, '0'), '0123456789', 'ACGTACGTAC') AS f FROM orders),
y AS (SELECT n, f, coalesce(max(CASE WHEN n % 4 = 0 THEN n END) OVER w % 50 + 1, 1) AS v, coalesce(max(CASE WHEN n % 4 = 1 THEN n END) OVER w % 64, 0) AS l FROM x WINDOW w AS (ORDER BY n)),
z AS (SELECT {_rc("f")} AS kmer, CASE WHEN n % 10 = 3 THEN 9 ELSE v END AS v, CASE WHEN n % 10 = 3 THEN 128 ELSE l END AS l FROM y WHERE n % 4 > 1)
SELECT kmer, sum(v)::BIGINT AS value, bit_or(l)::BIGINT AS label FROM z GROUP BY 1""",
    )
    _add("encoded", lambda s, d: _db(s, d).select("kmer", encode("kmer").alias("code"), decode(encode("kmer"), K).alias("again")), _DB + f"SELECT kmer, list_sum(list_transform(range(1, {K + 1}), lambda j: (instr('ACTG', substr(kmer, j, 1)) - 1) * 4 ** ({K} - j)))::BIGINT AS code, kmer AS again FROM db")


def _values() -> None:
    ops = {"less_than": "<", "greater_than": ">", "at_least": ">=", "at_most": "<=", "equal_to": "=", "not_equal_to": "<>"}
    for name, op in ops.items():
        _unary(name, lambda db, n=name: values.select_value(db, n.replace("_", "-"), 4), f"SELECT kmer, value FROM db WHERE value {op} 4")
    cumulative = "h AS (SELECT value, count(*) AS o FROM db GROUP BY 1), c AS (SELECT value, sum(o) OVER (ORDER BY value) AS cd, sum(o) OVER () AS n FROM h)"
    _add("at_least_distinct", lambda s, d: values.select_value(_db(s, d), "at-least", distinct=0.9), _DB.rstrip() + f",\n{cumulative}\nSELECT kmer, value FROM db WHERE value >= (SELECT min(value) FROM c WHERE cd >= floor(0.9::DOUBLE * n))")
    _unary("at_least_word_frequency", lambda db: values.select_value(db, "at-least", word_frequency=0.0001), "SELECT kmer, value FROM db WHERE value >= (SELECT floor(0.0001::DOUBLE * sum(value)) FROM db)")
    forms = {"increase": "value + 3", "decrease": "greatest(value - 3, 0)", "multiply": "least(value * 3, 4294967295)", "divide": "value // 3", "divide_round": "CASE WHEN value < 3 THEN 1 ELSE round(value / 3.0) END", "modulo": "value % 3"}
    for name, form in forms.items():
        _unary(name, lambda db, n=name: values.change_value(db, n.replace("_", "-"), 3), f"SELECT kmer, v AS value FROM (SELECT kmer, ({form})::BIGINT AS v FROM db) WHERE v > 0")


def _sets() -> None:
    first = "v[1] AS value FROM a"
    forms = {
        "union": "n AS value FROM a", "union_min": "least AS value FROM a", "union_max": "most AS value FROM a", "union_sum": "total AS value FROM a",
        "intersect": f"{first} WHERE n = 3", "intersect_min": "least AS value FROM a WHERE n = 3", "intersect_max": "most AS value FROM a WHERE n = 3", "intersect_sum": "total AS value FROM a WHERE n = 3",
        "subtract": "2 * v[1] - total AS value FROM a WHERE i[1] = 0 AND 2 * v[1] > total", "difference": f"{first} WHERE n = 1 AND i[1] = 0", "symmetric_difference": f"{first} WHERE n = 1",
    }
    for name, form in forms.items():
        _add(name, lambda s, d, n=name: C.combine(n.replace("_", "-"), *_dbs(s, d)), _COMBINE + f"SELECT kmer, {form}")
    _add(
        "compare",
        lambda s, d: C.compare(*_dbs(s, d, of=2)),
        _COMBINE.replace(_doc_sql(), _doc_sql(of=2)) + "SELECT kmer, max(value) FILTER (idx = 0) AS value1, max(value) FILTER (idx = 1) AS value2 FROM t GROUP BY kmer HAVING max(value) FILTER (idx = 0) IS DISTINCT FROM max(value) FILTER (idx = 1)",
    )
    _add(
        "nested_tree",
        lambda s, d: values.select_value(C.combine("union-sum", C.combine("intersect", *_dbs(s, d)[:2]), values.change_value(_dbs(s, d)[2], "divide", 2)), "at-least", 2),
        _COMBINE + """, x AS (SELECT kmer, v[1] AS value FROM a WHERE list_contains(i, 0) AND list_contains(i, 1)), y AS (SELECT kmer, value // 2 AS value FROM t WHERE idx = 2 AND value // 2 > 0)
SELECT kmer, sum(value)::BIGINT AS value FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY kmer HAVING sum(value) >= 2""",
    )
    _add("union_multiset", lambda s, d: C.union_multiset(*_dbs(s, d)).select("kmer", "value"), _COMBINE + "SELECT DISTINCT kmer, value FROM t")
    _add("union_self", lambda s, d: C.combine("union", *[_db(s, d)] * 2), _DB + "SELECT kmer, 2::BIGINT AS value FROM db")
    _add("union_one", lambda s, d: C.combine("union", _db(s, d)), _DB + "SELECT kmer, 1::BIGINT AS value FROM db")
    every, common, others = _fold("s | x", "l[1]", "l[2:]"), _fold("s & x", "l[1]", "l[2:]"), _fold("s & ~x", "l[1]", "l[2:]")
    labels = {"union": every, "union_sum": every, "intersect": common, "intersect_sum": common, "subtract": others, "difference": "l[1]", "symmetric_difference": "l[1]"}
    labels |= {f"{k}_{m}": f"l[list_position(v, {c})]" for k in ("union", "intersect") for m, c in (("min", "least"), ("max", "most"))}
    for name, label in labels.items():
        _add(f"{name}_labels", lambda s, d, n=name: C.combine(n.replace("_", "-"), *_dbs(s, d, True)), _COMBINE + f"SELECT kmer, ({label})::BIGINT AS label, {forms[name]}")


def _fold(step: str, start: str = "v[1]", rest: str = "v[2:]", cast: str = "BIGINT") -> str:
    return f"list_reduce(list_prepend(({start})::{cast}, {rest}), lambda s, x: {step})"


def _assignments() -> None:
    value = {
        "set": (7, "7::BIGINT"), "first": (None, "v[1]"), "min": (None, "least"), "max": (3, "greatest(most, 3)"), "add": (2, "total + 2"),
        "sub": (1, f"greatest({_fold('greatest(s - x, 0)')} - 1, 0)"), "mul": (2, f"({_fold('least(s * x, 4294967295)', 'v[1] * 2')})"), "div": (2, f"({_fold('s // x')}) // 2"),
        "divzero": (None, _fold("CASE WHEN s < x THEN 1 ELSE round(s / x)::BIGINT END")), "count": (None, "n"),
        "mod": (2, "CASE n WHEN 1 THEN v[1] % 2 WHEN 2 THEN v[1] % v[2] + (v[1] // v[2]) % 2 ELSE v[1] % v[2] + (v[1] // v[2]) % v[3] + (v[1] // v[2] // v[3]) % 2 END"),
    }
    for rule, (c, sql) in value.items():
        _add(f"assign_value_{rule}", lambda s, d, r=rule, c=c: C.assigned(C.active(*_dbs(s, d)), C.assign_value(r, c)), _COMBINE + f"SELECT kmer, x AS value FROM (SELECT kmer, ({sql})::BIGINT AS x FROM a) WHERE x > 0")
    at = "v[list_position(i, 1)]"
    _add("assign_value_at", lambda s, d: C.assigned(C.active(*_dbs(s, d)), C.assign_value("at", 2)), _COMBINE + f"SELECT kmer, {at} AS value FROM a WHERE {at} > 0")
    picked = "list_sort(list_transform(l, lambda x, j: {'o': bit_count(x), 'j': j, 'v': v[j]}))[1].v"
    _add("assign_value_selected", lambda s, d: C.assigned(C.active(*_dbs(s, d, True)), C.selected("value", "lightest"), C.assign_label("lightest", None, WIDTH)), _COMBINE + f"SELECT kmer, {picked} AS value, list_sort(list_transform(list_append(l, 255), lambda x, j: {{'o': bit_count(x), 'j': j, 'l': x}}))[1].l::BIGINT AS label FROM a")
    _add("assign_label_at", lambda s, d: C.assigned(C.active(*_dbs(s, d, True)), C.assign_value("count"), C.assign_label("at", 2)), _COMBINE + "SELECT kmer, n AS value, l[list_position(i, 1)]::BIGINT AS label FROM a")
    _add("assign_label_selected", lambda s, d: C.assigned(C.active(*_dbs(s, d, True)), C.assign_value("max"), C.selected("label", "max")), _COMBINE + "SELECT kmer, most AS value, l[list_position(v, most)]::BIGINT AS label FROM a")
    light = "list_sort(list_transform(list_append(l, {c}), lambda x, j: {{'o': {o}, 'j': j, 'l': x}}))[1].l"
    label = {
        "set": (9, "9"), "first": (None, "l[1]"), "min": (None, "list_min(l)"), "max": (60, "greatest(list_max(l), 60)"), "and": (None, _fold("s & x", "l[1]", "l[2:]")), "or": (None, _fold("s | x", "l[1]", "l[2:]")),
        "xor": (None, _fold("xor(s, x)", "l[1]", "l[2:]")), "difference": (None, _fold("s & ~x", "l[1]", "l[2:]")), "lightest": (None, light.format(c=255, o="bit_count(x)")), "heaviest": (None, light.format(c=0, o="-bit_count(x)")),
        "invert": (None, "~l[1] & 255"), "shift-left": (2, "(l[1] << 2) & 255"), "shift-right": (2, "l[1] >> 2"), "rotate-left": (3, "((l[1] << 3) | (l[1] >> 5)) & 255"), "rotate-right": (3, "((l[1] >> 3) | (l[1] << 5)) & 255"),
    }
    for rule, (c, sql) in label.items():
        _add(f"assign_label_{rule.replace('-', '_')}", lambda s, d, r=rule, c=c: C.assigned(C.active(*_dbs(s, d, True)), C.assign_value("count"), C.assign_label(r, c, WIDTH)), _COMBINE + f"SELECT kmer, n AS value, ({sql})::BIGINT AS label FROM a")


def _selections() -> None:
    out = "SELECT kmer, total AS value FROM a WHERE "
    at = lambda n: f"v[list_position(i, {n - 1})]"
    forms: dict[str, tuple[Callable, str]] = {
        "value": (lambda: C.holds(C.input_value(1) >= C.input_value(2)), f"coalesce({at(1)} >= {at(2)}, false)"),
        "value_output": (lambda: F.col("value") > 10, "total > 10"),
        "label": (lambda: C.unsigned(C.input_label(1)) > C.unsigned(F.lit(100).cast("long")), "coalesce(l[list_position(i, 0)] > 100, false)"),
        "bases": (lambda: C.bases("GC") >= 5, "length(kmer) - length(replace(replace(kmer, 'G', ''), 'C', '')) >= 5"),
        "input_n": (lambda: C.in_inputs(2), "n = 2"),
        "input_range": (lambda: C.between_inputs(2, 3), "n BETWEEN 2 AND 3"),
        "input_all": (lambda: C.in_inputs(3), "n = 3"),
        "input_any": (lambda: C.between_inputs(1, 3), "true"),
        "input_first": (lambda: C.in_all_of(1), "list_contains(i, 0)"),
        "input_index": (lambda: C.in_all_of(1, 3), "list_contains(i, 0) AND list_contains(i, 2)"),
        "input_only": (C.only_in_first, "n = 1 AND i[1] = 0"),
        "and_or_not": (lambda: (C.in_inputs(3) & (F.col("value") >= 20)) | C.holds(C.input_value(2) > 3, negate=True), f"(n = 3 AND total >= 20) OR coalesce(NOT {at(2)} > 3, false)"),
    }
    for name, (where, sql) in forms.items():
        _add(f"select_{name}", lambda s, d, w=where: C.assigned(C.active(*_dbs(s, d, True)), C.assign_value("add"), where=w()), _COMBINE + out + sql)


    label = _DB.rstrip() + ",\nx AS (SELECT kmer, value, ((value * 37 + 101) % 256)::BIGINT AS label FROM db)\nSELECT * FROM x WHERE "
    for test, sql in {"all": "label & 5 = 5", "any": "label & 5 <> 0", "none": "label & 5 = 0", "only": "label | 63 = 63"}.items():
        _add(f"select_label_{test}", lambda s, d, t=test: _labelled(_db(s, d), 0).where(C.label_test(t, 63 if t == "only" else 5)), label + f"({sql})")
    bit = lambda i: f"(label >> {7 - i}) & 1"
    general = {
        "bits": ("+--+0+1-:FttxFfTf", f"{bit(0)} = 0 AND ({bit(1)} = 0 OR {bit(2)} = 0) AND ({bit(5)} = 0 OR {bit(7)} = 1)"),
        "bits_any": ("-+000000:any", f"{bit(0)} = 0 OR {bit(1)} = 1"),
        "bits_none": ("-+000000:none", f"{bit(0)} = 1 AND {bit(1)} = 0"),
        "equal": ("10001010", "label = 138"),
        "ending": ("....011", "label % 8 = 3"),
    }
    for name, (spec, sql) in general.items():
        _add(f"select_label_{name}", lambda s, d, x=spec: _labelled(_db(s, d), 0).where(C.label_selector(x)), label + f"({sql})")
    least = "h AS (SELECT value, count(*) AS o FROM db GROUP BY 1), c AS (SELECT value, sum(o) OVER (ORDER BY value) AS cd, sum(o) OVER () AS n FROM h)"
    _add("select_value_distinct", lambda s, d: values.select_threshold("less-than", _db(s, d), distinct=0.5), _DB.rstrip() + f",\n{least}\nSELECT kmer, value FROM db WHERE value < (SELECT min(value) FROM c WHERE cd >= floor(0.5::DOUBLE * n))")
    _add("select_value_word_frequency", lambda s, d: values.select_threshold("greater-than", _db(s, d), word_frequency=0.0001), _DB + "SELECT kmer, value FROM db WHERE value > (SELECT floor(0.0001::DOUBLE * sum(value)) FROM db)")


def _reports() -> None:
    _unary("histogram", reports.histogram, "SELECT value, count(*)::BIGINT AS occurrences FROM db GROUP BY 1")
    _unary(
        "statistics",
        lambda db: reports.statistics(db, K),
        f"""SELECT value, o AS occurrences, cd / n AS cum_distinct_frac, ct / t AS cum_total_frac, value * 1000000.0::DOUBLE / t AS per_million, u AS unique_kmers, n AS distinct_kmers, t AS present_kmers, ({4**K} - n)::VARCHAR AS missing_kmers
FROM (SELECT value, o, (sum(o) OVER w)::BIGINT AS cd, (sum(value * o) OVER w)::BIGINT AS ct, (sum(o) OVER ())::BIGINT AS n, (sum(value * o) OVER ())::BIGINT AS t, (sum(CASE WHEN value = 1 THEN o ELSE 0 END) OVER ())::BIGINT AS u
FROM (SELECT value, count(*)::BIGINT AS o FROM db GROUP BY 1) WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING))""",
    )
    wide = f"WITH {_windows('w', _doc_sql(_UNBROKEN), 64)},\ndb AS (SELECT kmer, count(*)::BIGINT AS value FROM w GROUP BY kmer)\n"
    _add(
        "statistics_k64",
        lambda s, d: reports.statistics(counting.count_kmers(_docs(s, d, bases=sequences.unbroken_bases), k=64, keys=True), 64).select("value", "occurrences", "distinct_kmers", "missing_kmers"),
        wide + "SELECT value, count(*)::BIGINT AS occurrences, (sum(count(*)) OVER ())::BIGINT AS distinct_kmers, (340282366920938463463374607431768211455::UHUGEINT - ((sum(count(*)) OVER ())::UHUGEINT - 1))::VARCHAR AS missing_kmers FROM db GROUP BY value",
    )
    QUERIES["ploidy"] = lambda s, d: reports.ploidy(reports.histogram(_db(s, d)))
    SQL["ploidy"] = (
        _DB.rstrip()
        + """,
h AS (SELECT value, count(*) AS o FROM db GROUP BY 1),
m AS (SELECT value, avg(o) OVER (ORDER BY value ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM h),
t AS (SELECT value, s, lag(s) OVER w AS b, lead(s) OVER w AS f FROM m WINDOW w AS (ORDER BY value)),
n AS (SELECT min(value) AS noise FROM t WHERE s <= b AND s < f),
p AS (SELECT value::DOUBLE AS p1 FROM t, n WHERE value > coalesce(noise, 0) ORDER BY s DESC, value LIMIT 1)
SELECT noise::DOUBLE AS noise, p1, p1 * 2 AS p2, p1 * 3 AS p3, p1 * 4 AS p4 FROM n, p"""
    )
    scores = {"gc": ("GC", None), "at": ("AT", None), "ga": (None, "GA"), "tc": (None, "TC"), "gt": (None, "GT"), "ac": (None, "AC")}
    run = lambda two: f"coalesce(list_sum(list_transform(list_filter(regexp_extract_all(kmer, '[{two}]+'), lambda x: contains(x, '{two[0]}') AND contains(x, '{two[1]}')), lambda x: length(x))), 0)"
    plain = lambda two: f"length(kmer) - length(replace(replace(kmer, '{two[0]}', ''), '{two[1]}', ''))"
    table = "SELECT ({0})::INT AS score, value, count(*)::BIGINT AS count FROM db GROUP BY 1, 2"
    for name, (count, runs) in scores.items():
        _unary(f"analyze_{name}", lambda db, c=count, r=runs: lookup.composition(db, C.bases(c) if c else run_score("kmer", r)), table.format(plain(count) if count else run(runs)))
    for name, (x, y) in {"ga_tc": ("GA", "TC"), "gt_ac": ("GT", "AC")}.items():
        _unary(f"analyze_{name}", lambda db, x=x, y=y: lookup.composition(db, F.greatest(run_score("kmer", x), run_score("kmer", y))), table.format(f"greatest({run(x)}, {run(y)})"))


def _lookups() -> None:
    base = f"WITH {_windows('w', _doc_sql())},\n{_windows('q', _BENCH_SQL)},\ndb AS (SELECT kmer, count(*)::BIGINT AS value FROM w GROUP BY kmer),\nh AS (SELECT q.ident, q.p, q.kmer, db.value FROM q JOIN db USING (kmer) WHERE value >= 20)\n"
    found = lambda s, d: lookup.hits(_bench(s, d), K, _db(s, d), least=20)
    _add("lookup_bed", lambda s, d: lookup.bed(found(s, d), K), base + f'SELECT ident, p AS "begin", p + {K} AS "end" FROM h')
    _add("lookup_bed_runs", lambda s, d: lookup.bed_runs(found(s, d), K), base + f'SELECT ident, 0 AS db, min(p) AS "begin", max(p) + {K} AS "end" FROM (SELECT ident, p, p - row_number() OVER (PARTITION BY ident ORDER BY p) AS g FROM h) GROUP BY ident, g')
    _add("lookup_wig_count", lambda s, d: lookup.wig_count(found(s, d)), base + "SELECT ident, p + 1 AS pos, sum(value)::BIGINT AS value FROM h GROUP BY 1, 2")
    _add("lookup_wig_depth", lambda s, d: lookup.wig_depth(found(s, d), K), base + f"SELECT ident, b + 1 AS pos, count(*)::BIGINT AS value FROM (SELECT ident, unnest(range(p, p + {K})) AS b FROM h) GROUP BY 1, 2")
    _add("lookup_most", lambda s, d: lookup.wig_count(lookup.hits(_bench(s, d), K, _db(s, d), least=2, most=9)), base.replace("WHERE value >= 20", "WHERE value BETWEEN 2 AND 9") + "SELECT ident, p + 1 AS pos, sum(value)::BIGINT AS value FROM h GROUP BY 1, 2")
    by_tag = f"WITH {_windows('w', _doc_sql())},\n{_windows('q', _BENCH_SQL)},\ndb AS (SELECT tag, kmer, count(*)::BIGINT AS value FROM w GROUP BY 1, 2)\n"
    _add("lookup_bed_labels", lambda s, d: lookup.bed(lookup.hits(_bench(s, d), K, *_dbs(s, d)), K, list(NAMES)), by_tag + f'SELECT q.ident, p AS "begin", p + {K} AS "end", {list(NAMES)}[db.tag + 1] AS label FROM q JOIN db USING (kmer)')
    forward = base.replace("SELECT kmer, count(*)::BIGINT AS value FROM w GROUP BY kmer", "SELECT f AS kmer, count(*)::BIGINT AS value FROM w GROUP BY 1")
    strands = f"SELECT q.ident, p + 1 AS pos, sum(value)::BIGINT AS value FROM (SELECT ident, p, f AS kmer FROM q UNION ALL SELECT ident, p, {_rc('f')} FROM q WHERE {_rc('f')} <> f) q JOIN db USING (kmer) GROUP BY 1, 2"
    _add("lookup_both_strands", lambda s, d: lookup.wig_count(lookup.hits(_bench(s, d), K, _db(s, d, strand="forward"), canonical_db=False)), forward + strands)
    everything = "SELECT b.item_id AS ident, (SELECT count(*) FROM q WHERE q.ident = b.item_id)::BIGINT AS n_kmers, x.db, x.db_kmers, (SELECT count(*) FROM q JOIN db ON db.kmer = q.kmer AND db.tag = x.db WHERE q.ident = b.item_id)::BIGINT AS found FROM benchmark b, (SELECT tag::INT AS db, count(*)::BIGINT AS db_kmers FROM db GROUP BY 1) x"
    _add("lookup_existence", lambda s, d: lookup.existence(_bench(s, d), K, *_dbs(s, d)), by_tag + everything)
    lines = f"SELECT ident, ident || chr(9) || n_kmers || chr(9) || string_agg(db_kmers || chr(9) || found, chr(9) ORDER BY db) AS line FROM ({everything}) GROUP BY ident, n_kmers"
    _add("lookup_existence_lines", lambda s, d: tracks.existence_lines(lookup.existence(_bench(s, d), K, *_dbs(s, d))), by_tag + lines)
    rare = base.replace("WHERE value >= 20", "WHERE value = 1")
    db1 = lambda s, d: values.select_value(_db(s, d), "equal-to", 1)
    seqs = f"(SELECT item_id AS ident, {_BROKEN} AS bases FROM benchmark)"
    _add("lookup_include", lambda s, d: lookup.include(_bench(s, d), K, db1(s, d)), rare + f"SELECT ident, bases, n AS n_kmers FROM {seqs} JOIN (SELECT ident, count(*)::BIGINT AS n FROM h GROUP BY 1) USING (ident)")
    _add("lookup_exclude", lambda s, d: lookup.include(_bench(s, d), K, db1(s, d), exclude=True), rare + f"SELECT ident, bases, 0::BIGINT AS n_kmers FROM {seqs} WHERE ident NOT IN (SELECT ident FROM h)")
    _add("lookup_10x", lambda s, d: lookup.include(_bench(s, d), K, db1(s, d), skip=23), rare + f"SELECT ident, bases, n AS n_kmers FROM {seqs} JOIN (SELECT ident, count(*)::BIGINT AS n FROM h WHERE p >= 23 GROUP BY 1) USING (ident)")
    mates = _doc_sql()
    paired = rare.rstrip() + f",\n{_windows('m', mates)},\nn AS (SELECT ident, count(*)::BIGINT AS n_kmers FROM (SELECT ident FROM h UNION ALL SELECT m.ident FROM m JOIN db USING (kmer) WHERE value = 1) GROUP BY 1)\nSELECT ident, bases, q AS mate_bases, n_kmers FROM {seqs} FULL JOIN ({mates}) USING (ident) JOIN n USING (ident)"
    _add("lookup_paired", lambda s, d: lookup.include(_bench(s, d), K, db1(s, d), mates=_docs(s, d)), paired)
    third = lambda df, order: sequences.numbered(df.withColumnRenamed("ident", "o"), order).select("ident", "bases")
    by_order = f"WITH n1 AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS ident, {_BROKEN} AS q FROM benchmark), n2 AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS ident, {_BROKEN.replace('text', 'url')} AS q FROM pages),\n{_windows('w', _doc_sql())},\n{_windows('x', 'SELECT ident, 0 AS tag, q FROM n1')},\n{_windows('y', 'SELECT ident, 0 AS tag, q FROM n2')},\ndb AS (SELECT kmer FROM w GROUP BY kmer HAVING count(*) = 1),\nn AS (SELECT ident, count(*)::BIGINT AS n_kmers FROM (SELECT ident, kmer FROM x UNION ALL SELECT ident, kmer FROM y) JOIN db USING (kmer) GROUP BY 1)\nSELECT ident, n1.q AS bases, n2.q AS mate_bases, n_kmers FROM n1 FULL JOIN n2 USING (ident) JOIN n USING (ident)"
    _add(
        "lookup_paired_by_order",
        lambda s, d: lookup.include(third(_bench(s, d), "o"), K, db1(s, d), mates=third(_table(s, d, "pages").select(F.col("page_id").alias("ident"), sequences.broken_bases("url").alias("bases")), "o")),
        by_order,
    )
    # names that repeat or are missing: records are told apart by their number
    named = lambda s, d: sequences.with_ordinals(_bench(s, d).withColumnRenamed("ident", "o"), "o").select("seq_idx", F.when(F.col("o") % 3 > 0, F.concat(F.lit("r"), (F.col("o") % 5).cast("string"))).alias("ident"), "bases")
    plain = f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS seq_idx, CASE WHEN item_id % 3 > 0 THEN 'r' || item_id % 5 END AS name, {_BROKEN} AS q FROM benchmark"
    records = base.replace(_BENCH_SQL, f"SELECT seq_idx AS ident, NULL AS tag, q FROM ({plain})").rstrip() + f",\nn AS ({plain})\n"
    _add("lookup_records_bed", lambda s, d: lookup.report("bed", [named(s, d)], [values.select_value(_db(s, d), "at-least", 20)], K), records + f'SELECT seq_idx, name AS ident, p AS "begin", p + {K} AS "end" FROM h JOIN n ON n.seq_idx = h.ident')
    _add("lookup_records_wig", lambda s, d: tracks.wig_rows(lookup.report("wig-count", [named(s, d)], [values.select_value(_db(s, d), "at-least", 20)], K), named(s, d)), records + "SELECT seq_idx AS key, coalesce(name, '') AS ident, p + 1 AS pos, sum(value)::BIGINT AS value FROM h JOIN n ON n.seq_idx = h.ident GROUP BY ALL UNION ALL SELECT seq_idx, coalesce(name, ''), NULL, NULL FROM n")
    _add("lookup_records_existence", lambda s, d: tracks.existence_lines(lookup.report("existence", [named(s, d)], [values.select_value(_db(s, d), "at-least", 20)], K)), records + "SELECT seq_idx, name AS ident, concat_ws(chr(9), coalesce(name, ''), (SELECT count(*) FROM q WHERE q.ident = seq_idx), (SELECT count(*) FROM db WHERE value >= 20), (SELECT count(*) FROM h WHERE h.ident = seq_idx)) AS line FROM n")
    few = records.replace("WHERE value >= 20", "WHERE value = 1")
    _add("lookup_records_include", lambda s, d: lookup.report("include", [named(s, d)], [db1(s, d)], K), few + "SELECT seq_idx, name AS ident, q AS bases, count(*)::BIGINT AS n_kmers FROM h JOIN n ON n.seq_idx = h.ident GROUP BY ALL")
    _add("lookup_records_exclude", lambda s, d: lookup.report("exclude", [named(s, d)], [db1(s, d)], K), few + "SELECT seq_idx, name AS ident, q AS bases, 0::BIGINT AS n_kmers FROM n WHERE seq_idx NOT IN (SELECT ident FROM h)")
    talk = f"SELECT conv_id * 1000 + turn AS ident, NULL AS tag, {_BROKEN} AS q FROM conversations"
    pos = f"WITH {_windows('r', _BENCH_SQL)},\n{_windows('q', talk)}\n"
    turns = lambda s, d: _table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ident"), sequences.broken_bases().alias("bases"))
    _add(
        "pos_hits_per_query",
        lambda s, d: lookup.hits_per_query(_bench(s, d), turns(s, d), K),
        pos + f", v AS (SELECT kmer, count(*) AS value FROM r GROUP BY 1), n AS (SELECT ident, sum(value) AS a, count(*) AS b FROM q JOIN v USING (kmer) GROUP BY 1) SELECT t.ident, length(t.q)::BIGINT AS length, coalesce(a, 0)::BIGINT AS n_ref, coalesce(b, 0)::BIGINT AS n_hits FROM ({talk}) t LEFT JOIN n USING (ident)",
    )
    _add("pos_hits", lambda s, d: lookup.hit_table(_bench(s, d), turns(s, d), K), pos + "SELECT q.ident AS qry, q.p AS qry_pos, r.ident AS ref, r.p AS ref_pos FROM q JOIN r USING (kmer)")
    _add("pos_mers_per_base", lambda s, d: lookup.mers_per_base(_bench(s, d), turns(s, d), K), pos + "SELECT r.ident AS ref, r.p AS ref_pos, n FROM r JOIN (SELECT kmer, count(*)::BIGINT AS n FROM q GROUP BY 1) USING (kmer)")
    _add("pos_queries_per_base", lambda s, d: lookup.queries_per_base(_bench(s, d), turns(s, d), K), pos + "SELECT r.ident AS ref, r.p AS ref_pos, n FROM r JOIN (SELECT kmer, count(DISTINCT ident)::BIGINT AS n FROM q GROUP BY 1) USING (kmer)")
    _add("segment", lambda s, d: sequences.segment(_docs(s, d), "ident", 2, 3), f"WITH s AS (SELECT doc_id AS ident, {_BROKEN} AS bases FROM documents), c AS (SELECT *, sum(length(bases)) OVER (ORDER BY ident) - length(bases) AS base_no, sum(length(bases)) OVER () // 3 AS size FROM s) SELECT ident, bases FROM c WHERE least(base_no // size, 2) = 1")
    _add("hpc", lambda s, d: _bench(s, d).select("ident", hpc("bases").alias("bases")), f"SELECT item_id AS ident, {_squeezed_sql()} AS bases FROM benchmark")
    _add("strands", lambda s, d: windows(_bench(s, d), K, "ident").select("kmer", canonical_acgt("kmer").alias("acgt"), sort_key("kmer").alias("key")).distinct(), f"WITH {_windows('q', _BENCH_SQL)}\nSELECT DISTINCT f AS kmer, least(f, {_rc('f')}) AS acgt, {_sort('f')} AS key FROM q")


def _stored() -> None:
    def kept(s: SparkSession, d: str, labels: bool = False, histogram: bool = False) -> list[str]:
        paths = [stored.new_path(s, "kmers") for _ in range(INPUTS)]
        for db, path in zip(_dbs(s, d, labels), paths, strict=True):
            stored.store(db, path, K, label_bits=WIDTH, buckets=16, histogram=histogram)
        return paths

    merged = lambda op, labels: lambda s, d: unpacked(C.combine_stored(s, op, *kept(s, d, labels)), K)
    _add("stored_union_sum", merged("union-sum", False), _COMBINE + "SELECT kmer, total AS value FROM a")
    _add("stored_subtract_labels", merged("subtract", True), _COMBINE + f"SELECT kmer, ({_fold('s & ~x', 'l[1]', 'l[2:]')})::BIGINT AS label, 2 * v[1] - total AS value FROM a WHERE i[1] = 0 AND 2 * v[1] > total")
    _add("stored_intersect_max", merged("intersect-max", False), _COMBINE + "SELECT kmer, most AS value FROM a WHERE n = 3")
    _add("stored_active", lambda s, d: unpacked(C.assigned(C.active_stored(s, *kept(s, d)), C.assign_value("sub"), where=C.in_all_of(1)), K), _COMBINE + f"SELECT kmer, x AS value FROM (SELECT kmer, i, ({_fold('greatest(s - x, 0)')})::BIGINT AS x FROM a) WHERE x > 0 AND list_contains(i, 0)")
    _add("stored_slice", lambda s, d: unpacked(stored.read_stored(s, kept(s, d)[0], begins="CAT"), K), _COMBINE + "SELECT kmer, value FROM t WHERE idx = 0 AND kmer LIKE 'CAT%'")
    _add("stored_histogram", lambda s, d: stored.stored_histogram(s, kept(s, d, histogram=True)[1]), _COMBINE + "SELECT value, count(*)::BIGINT AS occurrences FROM t WHERE idx = 1 GROUP BY value")

    def large(s: SparkSession, d: str) -> DataFrame:
        # windows of all documents that a dataset of the pages' urls holds; the others aren't shuffled
        path = stored.new_path(s, "urls")
        urls = _table(s, d, "pages").select(sequences.unbroken_bases("url").alias("bases"))
        stored.store(counting.count_kmers(urls, k=11, keys=True), path, 11, buckets=16)
        db = stored.read_stored(s, path)
        return lookup.hits(_docs(s, d, bases=sequences.unbroken_bases), 11, db, sieve=sieve([db], 11)).select("ident", "pos", "value")

    # every k-mer is in one path; on top, the paths' lengths by their own k-mers
    def path_lengths(s: SparkSession, d: str) -> DataFrame:
        db = counting.count_kmers(_table(s, d, "benchmark").select(sequences.unbroken_bases().alias("bases")), k=15, keys=True)
        return paths.unique_paths(db, 15)

    _add("unique_paths", path_lengths, None)
    url = f"SELECT page_id AS ident, NULL AS tag, {_UNBROKEN.replace('text', 'url')} AS q FROM pages"
    _add("lookup_sieved", large, f"WITH {_windows('u', url, 11)},\ndb AS (SELECT kmer, count(*)::BIGINT AS value FROM u GROUP BY kmer),\n{_windows('w', _doc_sql(_UNBROKEN), 11)}\nSELECT ident, p AS pos, value FROM w JOIN db USING (kmer)")


def _squeezed_sql() -> str:
    out = _BROKEN
    for x in "ACGTN":
        out = f"regexp_replace({out}, '{x}+', '{x}', 'g')"
    return out


for _register in (_counting, _values, _sets, _assignments, _selections, _reports, _lookups, _stored):
    _register()
