"""Quality rules, and perplexity under a modified Kneser-Ney model of words and pairs of words.

Words are known by SLOTS bits of their hash, a pair by those of both.  Spark counts the pairs of all
texts: a task sorts its pairs, and sends each bucket one blob of differences, counts and numbers of
documents, some three bytes a pair.  The model keeps the pairs that two documents or more have, as
sorted arrays of hashes with their counts, one for each bucket; so it grows with the corpus, and no
text explains itself.  The mass of the others goes to the lower order, whose probabilities are those
of the words' different predecessors.  What the lower order needs is an array over all slots, whose
size is fixed, and which every task has.

Scoring: a task scores all its words by the lower order, and by the pairs that are FREQUENT, which
every task has too.  Of the others, those that the model may have (a bitmap says so) travel to their
bucket, where the sorted arrays are searched, and what a pair's own probability adds to its
document's sum travels back.

Documents outside the band of perplexity of their language, below or above, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .packing import pack, squeeze, unpack, unsqueeze
from .shared import Scratch, bitmap_of, maybe_in

U64 = np.uint64
SLOTS = 21  # bits of a word's hash: two words in two million are one
START = 0  # the slot before a text's first word
HELD = 2_000_000  # pairs that a task sorts at once
IN_BUCKET = 300_000  # pairs, about
FREQUENT = 1 << 16  # a pair is frequent if it is one of so many or fewer; so that there are at most so many
PARTS = 64  # in which arrays over all slots are added up
SPREADS = (6.0, 4.0)  # how many times as far as from the median to a quartile the band goes beyond it, below and above
LEAST_SPREAD = 0.1  # nats
SMALL = 30  # documents of a language under which there is no band
MOST_LANGUAGES = 10_000  # up to so many bands are broadcast

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_MODEL, _SLOTS, _COUNTS = 0, 1, 2  # kinds of rows that counting gives
_PAIRS, _TEXTS = 1, 2  # and that scoring sends besides
_ROWS = "kind int, bucket int, base long, blob binary"


def half_bits(words: float) -> int:
    """How many leading bits of either word of a pair name the bucket, so that no word, however frequent, has one to itself."""
    return min(10, max(2, (max(1, int(words)) // IN_BUCKET).bit_length() // 2 + 1))


def _rows(kind, bucket, base, blob) -> pa.RecordBatch:
    return T.rows(kind=pa.array(kind, pa.int32()), bucket=pa.array(bucket, pa.int32()), base=pa.array(base, pa.int64()), blob=pa.array(blob, pa.binary()))


def _pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word and of the one before it, for rows whose words begin at first."""
    w = (hashes >> U64(64 - SLOTS)).astype(np.int64)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[first[:-1][first[:-1] < first[1:]]] = START
    return v, w


def _sort_key(v: np.ndarray, w: np.ndarray, half: int) -> np.ndarray:
    """Pairs sort by bucket, then by word and the word before."""
    bucket = (w >> (SLOTS - half)) << half | v >> (SLOTS - half)
    return (bucket << (2 * SLOTS) | w << SLOTS | v).astype(U64)


def _by_bucket(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of sorted keys and other columns."""
    bucket = (key >> U64(2 * SLOTS)).astype(np.int64)
    pair = key & U64((1 << 2 * SLOTS) - 1)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True):
        yield int(bucket[a]), pack(pair[a:b], *(c[a:b] for c in columns))


def _counted(half: int):
    """Each task's pairs with their counts and numbers of documents."""

    def out(keys, docs):
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        other = np.ones(len(key), np.int64)
        other[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        some = list(_by_bucket(key[cut], np.diff(np.append(cut, len(key))), np.add.reduceat(other, cut)))
        return _rows([_MODEL] * len(some), [b for b, _ in some], [0] * len(some), [x for _, x in some])

    def f(batches):
        keys, docs, size, n = [], [], 0, 0
        for batch in batches:
            data, off = T.buffers(batch.column("text"))
            for i, j in T.groups(off):
                w = T.words(data, off, i, j)
                if len(w.hashes):
                    keys.append(_sort_key(*_pairs(w.hashes, w.first), half))
                    docs.append(np.repeat(np.arange(n, n + j - i), np.diff(w.first)))
                    size += len(w.hashes)
                n += j - i
                if size > HELD:  # between texts, so that a text is counted once
                    yield out(keys, docs)
                    keys, docs, size = [], [], 0
        if keys:
            yield out(keys, docs)

    return f


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(bucket, its rows) of rows sorted by bucket."""
    last, held = None, []
    for batch in batches:
        for kind, bucket, base, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "base", "blob")), strict=True):
            if bucket != last:
                if held:
                    yield last, held
                last, held = bucket, []
            held.append((kind, base, blob))
    if held:
        yield last, held


def _merged(batches):
    """The model's array of each bucket, and, at a task's end, sums by slot and counts of counts.

    By word: its different predecessors.  By the word before: all its pairs, those kept, and how many
    of these have the count 2, and 3 or more.
    """
    n = 1 << SLOTS
    before, total, kept = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    two, more, counts = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(4, np.int64)
    mask = U64(n - 1)
    for bucket, held in _buckets(batches):
        key, c, d = (np.concatenate(x) for x in zip(*(unpack(blob) for _, _, blob in held), strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, c, d = key[cut], np.add.reduceat(c[order], cut).astype(np.int64), np.add.reduceat(d[order], cut)
        w, v = (key >> U64(SLOTS)).astype(np.int64), (key & mask).astype(np.int64)
        np.add.at(before, w, 1)
        np.add.at(total, v, c)
        counts += np.bincount(np.minimum(c, 5), minlength=6)[1:5]
        stay = d > 1
        if stay.any():
            key, c, v = key[stay], c[stay], v[stay]
            np.add.at(kept, v, c)
            np.add.at(two, v[c == 2], 1)
            np.add.at(more, v[c > 2], 1)
            yield _rows([_MODEL], [bucket], [len(key)], [pack(key, c)])
    if counts.any():
        yield _rows([_COUNTS], [0], [0], [counts.tobytes()])
        for part, some in enumerate(np.split(np.arange(n), PARTS)):
            some = some[(before[some] > 0) | (total[some] > 0)]
            if len(some):
                yield _rows([_SLOTS], [part], [0], [pack(some, before[some], total[some], kept[some], two[some], more[some])])


def _added(batches):
    """Dense sums of the slots of a part."""
    for part, held in _buckets(batches):
        size = (1 << SLOTS) // PARTS
        out = np.zeros((5, size), np.int64)
        for _, _, blob in held:
            slot, *columns = unpack(blob)
            slot = (slot - U64(part * size)).astype(np.int64)
            for x, y in zip(out, columns, strict=True):
                x[slot] += y.astype(np.int64)
        yield _rows([_SLOTS], [part], [0], [squeeze(out.tobytes())])


def discounts(n: np.ndarray) -> list[float]:
    """The modified Kneser-Ney discounts for the counts 1, 2 and 3 or more, from how many have the counts 1 to 4."""
    n = [0, *(int(x) for x in n)]
    if not n[1] or not n[2]:
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), float(i)) if n[i] else i / 2 for i in (1, 2, 3)]


@dataclass
class Lower:
    """What every task has: the words' log-probabilities, the weights that contexts leave them, the contexts' totals, the pairs' discounts, a bitmap of the pairs kept, and the frequent ones."""

    log_p: np.ndarray
    log_left: np.ndarray
    total: np.ndarray
    d: list[float]
    bitmap: np.ndarray
    frequent: tuple[np.ndarray, np.ndarray]

    def find(self, key: np.ndarray, array: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs a sorted array of hashes has, and what their own log-probabilities add to those of the lower order."""
        have, count = array
        if not len(have):
            return np.zeros(len(key), bool), np.zeros(0)
        at = np.minimum(np.searchsorted(have, key), len(have) - 1)
        there = have[at] == key
        key, c = key[there], count[at[there]].astype(np.int64)
        v, w = (key & U64((1 << SLOTS) - 1)).astype(np.int64), (key >> U64(SLOTS)).astype(np.int64)
        low = self.log_left[v].astype(np.float64) + self.log_p[w]
        cut = np.array([0.0, *self.d])[np.minimum(c, 3)]
        return there, np.log((c - cut) / self.total[v] + np.exp(low)) - low


def lower_order(slots: np.ndarray, counts: np.ndarray, bitmap: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> Lower:
    """From the five sums by slot, and how many pairs have the counts 1 to 4."""
    before, total, kept, two, more = slots
    d = discounts(counts)
    d1 = np.array([0.0, *discounts(np.bincount(np.minimum(before, 5), minlength=6)[1:5])])
    cut = d1[np.minimum(before, 3)]
    every = max(1, int(before.sum()))
    p = (before - cut) / every + max(cut.sum(), 1e-9) / every / len(before)
    left = 1 - (kept - d[1] * two - d[2] * more) / np.maximum(total, 1)
    return Lower(np.log(p).astype(np.float32), np.log(np.clip(left, 1e-9, 1)).astype(np.float32), total.astype(np.float64), d, bitmap, frequent)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashes of the model's pairs, by which a bitmap knows them."""
    for batch in batches:
        for blob in batch.column("blob"):
            yield T.mix(unpack(blob.as_py())[0])


def _frequent(least: float):
    def f(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                key, c = unpack(blob.as_py())
                often = c >= least
                if often.any():
                    yield T.rows(pair=key[often].astype(np.int64), c=c[often].astype(np.int64))

    return f


def kneser_ney(scratch: Scratch, docs: DataFrame, half: int) -> tuple[DataFrame, Lower]:
    """The model's sorted arrays, rows (kind, bucket, base, blob) of a pair's hash and count, and the lower order."""
    counted = docs.select("text").mapInArrow(_counted(half), _ROWS)
    merged = scratch.table(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged, _ROWS), "model")
    added = merged.where(F.col("kind") == _SLOTS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_added, _ROWS)
    slots = np.zeros((5, 1 << SLOTS), np.int64)
    size = (1 << SLOTS) // PARTS
    for r in added.select("bucket", "blob").collect():
        slots[:, r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(unsqueeze(r["blob"]), np.int64).reshape(5, size)
    counts = np.zeros(4, np.int64)
    for r in merged.where(F.col("kind") == _COUNTS).groupBy("blob").count().collect():
        counts += np.frombuffer(r["blob"], np.int64) * r["count"]
    model = merged.where(F.col("kind") == _MODEL)
    n = model.agg(F.sum("base")).first()[0] or 0
    bitmap = bitmap_of(model.select("blob"), _kept, n)
    often = model.select("blob").mapInArrow(_frequent(max(2, slots[1].sum() / FREQUENT)), "pair long, c long").orderBy("pair").toArrow()
    return model, lower_order(slots, counts, bitmap, (often["pair"].to_numpy().astype(U64), often["c"].to_numpy().astype(U64)))


def base_counts(data: np.ndarray, off: np.ndarray, i: int, j: int, w: T.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the rows i..j."""
    n = j - i
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    lo = off[i]
    b = data[lo : off[j]]
    bounds = off[i : j + 1] - lo
    out["word_chars"] = np.diff(np.append(0, np.cumsum(T.WORD_BYTES[b] & ((b & 0xC0) != 0x80)))[bounds])
    out["n_symbols"] = np.diff(np.append(0, np.cumsum(_SYMBOL[b]))[bounds])
    out["n_words"] = np.diff(w.first)
    for r in range(n):
        text = b[bounds[r] : bounds[r + 1]].tobytes()
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
            out["n_dup_lines"][r] = len(lines) - len(set(lines))
        h = w.hashes[w.first[r] : w.first[r + 1]]
        if len(h) > 3:
            _, at, count = np.unique(T.shingles(h, 3), return_inverse=True, return_counts=True)
            if len(count) < len(at):
                twice = count[at] > 1
                over = np.zeros(len(h), bool)
                for k in range(3):
                    over[k : k + len(twice)] |= twice
                out["n_repeat_words"][r] = over.sum()
    return out


_COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scored(shared, half: int):
    """Base counts of each text with the sum of its words' log-probabilities by the lower order, and the pairs that the model may have."""

    def out(keys, rows):
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        some = list(_by_bucket(key[order], row[order]))
        return _rows([_PAIRS] * len(some), [b for b, _ in some], [TaskContext.get().partitionId() << 32] * len(some), [x for _, x in some])

    def f(batches):
        lower, part = shared.value, TaskContext.get().partitionId()
        keys, rows, size, n, turn = [], [], 0, 0, part
        for batch in batches:
            data, off = T.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            lang = batch.column("lang").to_numpy()
            for i, j in T.groups(off):
                w = T.words(data, off, i, j)
                counts = base_counts(data, off, i, j, w)
                sums = np.zeros(j - i)
                if len(w.hashes):
                    before, word = _pairs(w.hashes, w.first)
                    lp = np.append(0, np.cumsum(lower.log_left[before].astype(np.float64) + lower.log_p[word]))
                    sums = np.diff(lp[w.first])
                    key, row = _sort_key(before, word, half), np.repeat(np.arange(j - i), np.diff(w.first))
                    pair = key & U64((1 << 2 * SLOTS) - 1)
                    there, more = lower.find(pair, lower.frequent)
                    sums += np.bincount(row[there], more, j - i)
                    maybe = ~there & maybe_in(lower.bitmap, T.mix(pair))
                    keys.append(key[maybe])
                    rows.append(row[maybe] + n)
                    size += len(keys[-1])
                table = np.stack([known[i:j], ids[i:j], lang[i:j], *(counts[c] for c in _COUNTED), sums.view(np.int64)], 1)
                yield _rows([_TEXTS], [turn % (1 << 2 * half)], [(part << 32) + n], [squeeze(table.astype(np.int64).tobytes())])
                turn += 1
                n += j - i
                if size > HELD:
                    yield out(keys, rows)
                    keys, rows, size = [], [], 0
        if size:
            yield out(keys, rows)

    return f


_SCORED = f"doc_id long, lang long, {', '.join(f'{c} long' for c in _COUNTED)}, log_p double"


def _searched(shared):
    """What the pairs of a bucket that its array has add to the sums of their texts, packed by the task that read these; and the texts as they come."""

    def added(sums):
        out = []
        for base, held in sums.items():
            row, at = np.unique(np.concatenate([r for r, _ in held]), return_inverse=True)
            more = np.bincount(at, np.concatenate([x for _, x in held])).astype(np.float32)
            out.append((base, pack(row, more.view(np.uint32))))
        return _rows([_PAIRS] * len(out), [x >> 32 for x, _ in out], [x for x, _ in out], [x for _, x in out])

    def f(batches):
        lower = shared.value
        sums, size = {}, 0
        for _, held in _buckets(batches):
            array = next((unpack(blob) for kind, _, blob in held if kind == _MODEL), None)
            texts = [(base, blob) for kind, base, blob in held if kind == _TEXTS]
            if texts:
                yield _rows([_TEXTS] * len(texts), [x >> 32 for x, _ in texts], [x for x, _ in texts], [x for _, x in texts])
            for kind, base, blob in held:
                if kind == _PAIRS and array is not None:
                    key, row = unpack(blob)
                    there, more = lower.find(key, array)
                    if len(more):
                        sums.setdefault(base, []).append((row[there].astype(np.int64), more))
                        size += len(more)
            if size > HELD:
                yield added(sums)
                sums, size = {}, 0
        if sums:
            yield added(sums)

    return f


def _summed(batches):
    """The texts of each task with their sums; rows come sorted by the task, sums before texts."""
    part, sums = None, np.zeros(0)
    for batch in batches:
        for kind, bucket, base, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "base", "blob")), strict=True):
            if bucket != part:
                part, sums = bucket, np.zeros(0)
            if kind == _PAIRS:
                row, more = unpack(blob)
                row = row.astype(np.int64)
                if len(row) and row[-1] >= len(sums):
                    sums = np.append(sums, np.zeros(int(row[-1]) + 1 + len(sums)))
                sums[row] += more.astype(np.uint32).view(np.float32)
                continue
            t = np.frombuffer(unsqueeze(blob), np.int64).reshape(-1, 3 + len(_COUNTED) + 1).T.copy()
            at, more = base & 0xFFFFFFFF, np.zeros(t.shape[1])
            some = sums[at : at + len(more)]
            more[: len(some)] = some
            yield T.rows(doc_id=pa.array(t[1], mask=t[0] == 0), lang=t[2], **{c: t[3 + k] for k, c in enumerate(_COUNTED)}, log_p=t[-1].view(np.float64) + more)


def quality_rules(docs: DataFrame, spreads: tuple[float, float] = SPREADS) -> DataFrame:
    """Base counts, perplexity and verdict for each row of docs (doc_id, text, lang, ...).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (n_words < 50, or 100 * n_repeat_words > 50 * n_words), kept, perplexity (of a word; null without
    words), low and high (the language's band).  A band is made of the log-perplexities of the documents
    that pass the base rules: it reaches beyond either quartile, ``spreads`` times as far as that is
    from the median.  Copies have low ones, so that both sides differ.  Languages with fewer than
    SMALL such documents have none and reject nothing.  A null language is one of its own.  A null
    text is empty.  Repeated rows are documents of their own, as are rows without doc_id.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality-rules")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("lang", F.lit("\x00"))).alias("lang"))
    half = half_bits((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6)
    model, lower = kneser_ney(scratch, docs, half)
    shared = spark.sparkContext.broadcast(lower)
    sent = docs.mapInArrow(_scored(shared, half), _ROWS).unionByName(model)
    scored = scratch.table(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_searched(shared), _ROWS), "scored")
    stats = scored.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_summed, _SCORED)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    nats = F.when(F.col("n_words") > 0, -F.col("log_p") / F.col("n_words"))
    stats = scratch.table(stats.withColumn("base_failed", failed).withColumn("nats", nats).drop("log_p"), "stats")
    scratch.drop(scored)
    bands = stats.where("not base_failed").groupBy("lang").agg(F.percentile_approx("nats", [0.25, 0.5, 0.75], 10_000).alias("q"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= SMALL)
    below, above = (F.greatest(F.col("q")[i + 1] - F.col("q")[i], F.lit(LEAST_SPREAD)) * spreads[i] for i in (0, 1))
    bands = scratch.table(bands.select("lang", F.exp(F.col("q")[0] - below).alias("low"), F.exp(F.col("q")[2] + above).alias("high")), "bands")
    if bands.count() <= MOST_LANGUAGES:
        bands = F.broadcast(bands)
    out = stats.join(bands, "lang", "left").withColumn("perplexity", F.exp("nats"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", *_COUNTED, "base_failed", kept.alias("kept"), "perplexity", "low", "high")
