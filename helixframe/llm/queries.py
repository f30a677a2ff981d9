"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import archive_pages
from .conversation_trie import conversation_trie
from .decontamination import benchmark_matches, build_index
from .language_id import fit_languages, predict_languages
from .line_dedup import dedup_lines
from .minhash import minhash_components
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_components
from .periodic_runs import periodic_runs
from .pii import find_personal_data
from .quality_classifier import fit_quality, score_quality
from .quality_rules import quality_rules
from .substring_dedup import remove_repeated_windows

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_read(spark, sf_dir, "documents"), n=4, num=85, den=100)


def _near_sql(k: int) -> str:
    """Components of documents linked by k-word shingles at 0.85."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, {WORDS}), []) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i+{k - 1}], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * o >= 85 * (nx + ny - o)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS t FROM documents UNION SELECT r.d, b.y FROM r JOIN both_ways b ON b.x = r.t)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(r.t) AS component_id FROM s JOIN r ON r.d = s.doc_id GROUP BY 1, 2
"""


OP1_SQL = _near_sql(4)
OP13_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({_near_sql(3)})"


def _crc32_sql(text: str) -> str:
    """The CRC-32 of a string of digits."""
    shifts = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {shifts}), 4294967295)"


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the crc32 of doc_id's digits and g = h div 10, texts with h % 10 = 0 repeat p of their n words from word a = g % n on, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g")).where("h % 10 = 0").withColumn("w", words).where("size(w) > 0")
    some = some.withColumn("a", F.expr("g % size(w)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    some = some.select("doc_id", F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')").alias("text"))
    rest = docs.select("doc_id", "text").where((h % 10 != 0) | F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return some.unionByName(rest)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(made_periodic(_read(spark, sf_dir, "documents")), least=24, times=3)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _op11_sql() -> str:
    """Runs by windows of m words, m doubling: a run of period q in [m/2, m) meets its own windows again exactly q words on."""
    levels = [16 << k for k in range(17)]
    doubled = [f"h{m} AS (SELECT *, md5(h{m // 2} || lead(h{m // 2}, {m // 2}) OVER (PARTITION BY doc_id ORDER BY i)) AS h{m} FROM h{m // 2})" for m in levels[1:]]
    met = [
        f"SELECT doc_id, i, d, {m} AS m FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id, h{m} ORDER BY i) - i AS d FROM h{levels[-1]} WHERE h{m} IS NOT NULL) WHERE d >= {1 if m == 16 else m // 2} AND d < {m}"
        for m in levels
    ]
    return f"""
WITH c AS (SELECT doc_id, coalesce(regexp_extract_all(text, {WORDS}), []) AS w, {_crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
a AS (SELECT *, (h // 10) % greatest(len(w), 1) AS a FROM c),
p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
h16 AS (SELECT doc_id, i, CASE WHEN i + 16 <= len(w) THEN md5(array_to_string(w[i + 1:i + 16], ' ')) END AS h16 FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM t)),
{", ".join(doubled)},
met AS ({" UNION ALL ".join(met)}),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, m, d ORDER BY i) AS isle FROM met),
r AS (SELECT doc_id, min(i) AS start, count(*) - 1 + m + d AS length, d AS period FROM isles GROUP BY doc_id, m, d, isle HAVING count(*) - 1 + m + d >= greatest(24, 3 * d)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM r),
s AS (SELECT doc_id, count(*) AS n_runs, max(start) FILTER (WHERE place = 1) AS start, max(length) FILTER (WHERE place = 1) AS length, max(period) FILTER (WHERE place = 1) AS period,
      string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, list_distinct(flatten(list(range(start + period, start + length)))) AS gone FROM b GROUP BY doc_id),
g AS (SELECT doc_id, unnest(gone) AS i FROM s),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM t) u ANTI JOIN g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY u.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN s ON s.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
"""


OP11_SQL = _op11_sql()


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_read(spark, sf_dir, "conversations"), graft=True)


OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS g, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::BIGINT AS words FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM g),
c AS (SELECT conv_id, count(*) AS n, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM o GROUP BY conv_id),
i AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
r AS (SELECT conv_id, pos - h + k AS pos, g, words FROM o JOIN i USING (conv_id) WHERE pos > h
      UNION ALL SELECT i.conv_id, o.pos, o.g, o.words FROM i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 20 AND o.pos <= i.k),
p AS (SELECT conv_id, pos AS depth, words, md5(string_agg(g, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
m AS (SELECT node, min(depth) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
      coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM q GROUP BY node),
ch AS (SELECT parent AS node, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY parent),
n AS (SELECT m.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM m LEFT JOIN ch USING (node)),
s AS (SELECT q.node, sum((n.n_children = 0)::INT) AS n_leaves, sum(n.saved) AS saved_tokens
      FROM n JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY q.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN n u ON u.node = n.parent AND n.depth > 0
"""


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash_components(_read(spark, sf_dir, "documents"), n=3, num=85, den=100)
    return near.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_read(spark, sf_dir, "documents"), build_index(_read(spark, sf_dir, "benchmark")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS x FROM p),
d AS (SELECT page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) for i in range(32)], '') AS payload_digest FROM h),
f AS (SELECT payload_digest, min(page_id) AS least FROM d GROUP BY 1)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to FROM d JOIN f USING (payload_digest)
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_windows(_read(spark, sf_dir, "documents"), k=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, {WORDS}), []) AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM v GROUP BY g),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS p FROM v JOIN f USING (g) WHERE least < doc_id GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(coalesce(p, []))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(p, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_read(spark, sf_dir, "documents"))


def _crc(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = fit_languages(docs.where(_crc("doc_id", 4) != 2))
    return predict_languages(docs.select("doc_id", "text"), net).select("doc_id", (_crc("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = fit_quality(docs, _read(spark, sf_dir, "labels").where(_crc("doc_id", 5) != 0))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (_crc("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::BIGINT AS size, md5('1:' || doc_id) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][place % 3 + 1]::BIGINT AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, place) AS i,
      sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(w) OVER (ORDER BY cap::DOUBLE / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
f AS (SELECT min(i) AS i, arg_min(rest, i) AS rest, arg_min(share, i) AS share FROM o WHERE rest * w <= cap * share),
t AS (SELECT o.*, CASE WHEN o.i >= f.i THEN (o.w * f.rest)::DOUBLE / f.share::DOUBLE ELSE o.cap::DOUBLE END AS target FROM o LEFT JOIN f ON true),
q AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS rounds FROM t),
c AS (SELECT d.*, q.source_size, q.target, q.rounds, round(q.target)::BIGINT - q.rounds * q.source_size AS left_over,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(k, 1, 3), k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(size, left_over - before)))::BIGINT AS taken FROM c
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_read(spark, sf_dir, "documents"), drop_emptied=False, counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_mixing_sources": op6_mixing_sources,
    "op7_line_dedup": op7_line_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_warc": op9_warc,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_minhash": op13_minhash,
}
SQL = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op6_mixing_sources": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_minhash": OP13_SQL,
}
