"""Benchmark decontamination: BM25 retrieval of test items for every training passage, then overlap.

Items, questions and answers are units of an inverted index.  The list of a term has its impact on
each unit that holds it, and the greatest impact in each block of BLOCK neighbouring units.  As in
block-max WAND, a passage's sum of block maxima bounds its scores for all units of a block, and only
blocks whose bound reaches the threshold are scored.  Long lists are skipped: as long as what the
skipped terms could add to a block stays under SKIPPED of the threshold, their lists aren't read at
all, and their possible share is added to the block's bound instead.  Every passage of every text is
a query, and every unit above the threshold is retrieved.

The question is the item without its last sentence, the answer its last sentence.  Scores are
relative to the unit's score for itself, so that a text that quotes only one of them is found
whatever the others weigh.  What is retrieved is verified: the shares of the question's, the answer's
and the whole item's word n-grams that the text has near the passage, as far on each side as the
item is long, decide.

The index is built by Spark tasks, in shards of about SHARD items or SHARD_TERMS terms, and written
to the shared folder.  A shard takes some 60 bytes a term, under 150 MB, and is broadcast; all
documents are read once a shard.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import Scratch

U64 = np.uint64
K1, B = 1.2, 0.75
PASSAGE, STRIDE = 64, 32  # terms
BLOCK = 4  # units: items, questions and answers
CELLS = 1 << 21  # bounds of strides and blocks that are held at once
SHARD, SHARD_TERMS = 25_000, 1 << 21
THRESHOLD = 0.5
SKIPPED = 0.2  # of the threshold, that lists not read may add
NGRAM = 5
QUESTION, ANSWER, WHOLE = 0.6, 0.6, 0.5  # shares of n-grams
LEAST = 3  # telling words of a question that may decide alone
LETTERS = 4  # letters of scripts without spaces that tell as much as a word
#: Words that tell nothing of a question.
COMMON = frozenset(
    """a an the of in on at to for from by with as and or not no if is are was were be been do does did has have had can could will would should may must it its this that these those there
    which what who whom whose when where why how following true false correct incorrect answer option statement best most choose select one all any
    der die das den dem des ein eine einer eines und oder nicht ist sind war wer was wie wo wann warum welche welcher welches folgende folgenden richtig falsch von zu mit
    le la les un une des de du et ou ne pas est sont qui que quoi quel quelle quels quelles comment pourquoi vrai vraie faux suivant suivante suivantes
    el los las una unos unas y o no es son que cual cuales como cuando donde siguiente siguientes verdadero verdadera falso correcta""".split()
)

_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])\s*")
#: Letters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana and Han.  Each is a term.
_CONTINUOUS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Their punctuation, and full-width signs.
_STOPS = re.compile("[\u3000-\u3004\u3008-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")


def parts(text: str) -> tuple[str, str]:
    """Question and answer: all but the last sentence, and the last; of a single sentence it is both."""
    s = [x for x in _SENTENCE.split(text.strip()) if x]
    return (" ".join(s[:-1]), s[-1]) if len(s) > 1 else (text, text)


def spread(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts in which letters of scripts without spaces stand alone, and their punctuation is white space."""
    data, off = T.buffers(texts)
    some = data[off[0] : off[-1]] if len(off) else data
    if not ((some >= 0xE0) & (some != 0xE2)).any():
        return data, off
    return T.buffers(pa.array([_STOPS.sub(" ", _CONTINUOUS.sub(r" \g<0> ", x)) if x and not x.isascii() else x for x in texts.to_pylist()], pa.large_string()))


def _terms(texts: list[str]) -> list[np.ndarray]:
    data, off = spread(pa.array(texts, pa.string()))
    out = []
    for i, j in T.groups(off):
        w = T.words(data, off, i, j, T.TERM_BYTES, T.LOWER_VALUES)
        out += [w.hashes[w.first[r] : w.first[r + 1]] for r in range(j - i)]
    return out


def _lists(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the list of each of n keys begins among sorted keys, and the end."""
    return np.searchsorted(keys, np.arange(n + 1))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of each i, size[i] of them."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def telling(text: str) -> float:
    """How many words of a text aren't COMMON, each once; LETTERS letters of scripts without spaces are one."""
    letters = set(_CONTINUOUS.findall(text))
    words = set(re.findall(r"[^\W_]+", _CONTINUOUS.sub(" ", text).lower())) - COMMON
    return len(words) + len(letters) / LETTERS


class Index:
    """Inverted lists of BM25 impacts for a shard of items, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, df: dict[int, int], mean: float):
        self.ids = np.array([i for i, _ in items], np.int64)
        terms = _terms([t for _, t in items])
        split = [parts(t) for _, t in items]
        self.sizes = np.array([len(t) for t in terms], np.int64)
        parts_ = [[t, q, a] for t, q, a in zip(terms, _terms([q for q, _ in split]), _terms([a for _, a in split]), strict=True)]
        self.grams = [[(min(NGRAM, len(u)), np.unique(T.shingles(u, NGRAM))) for u in units] for units in parts_]
        self.alone = np.array([telling(q) >= min(LEAST, telling(t)) for (_, t), (q, _) in zip(items, split, strict=True)], bool)
        self.vocabulary = np.unique(np.concatenate([*terms, np.zeros(0, U64)]))
        units = []
        for x, (_, t) in enumerate(items):
            units.append((x, parts_[x][0]))
            if split[x][0] != t:
                if self.alone[x]:
                    units.append((x, parts_[x][1]))
                if _share(self.grams[x][0][1], self.grams[x][2][1]) >= WHOLE:  # a shorter answer can't decide alone
                    units.append((x, parts_[x][2]))
        self.item = np.array([x for x, _ in units], np.int64)
        self.blocks = -(-len(units) // BLOCK)
        place, unit, impact = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for x, (_, t) in enumerate(units):
            if not len(t):
                continue
            u, tf = np.unique(t, return_counts=True)
            d = np.array([df.get(int(h), 1) for h in u.tolist()], np.float64)
            idf = np.log(1 + (n_items - d + 0.5) / (d + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
            place.append(np.searchsorted(self.vocabulary, u))
            unit.append(np.full(len(u), x))
            impact.append(w / max(w.sum() * min(1.0, PASSAGE / len(t)), 1e-9))
        place, unit, impact = np.concatenate(place), np.concatenate(unit), np.concatenate(impact)
        # by unit, for scoring the units of a block
        self.unit_first = _lists(unit, self.blocks * BLOCK).astype(np.int64)
        self.unit_place, self.unit_impact = place.astype(np.int32), impact
        # by term: blocks and maxima
        key = place * max(1, self.blocks) + unit // BLOCK
        order = np.argsort(key, kind="stable")
        key, cut = key[order], np.flatnonzero(np.diff(key[order], prepend=-1))
        most = np.maximum.reduceat(impact[order], cut) if len(cut) else np.zeros(0)
        term, block = np.divmod(key[cut], max(1, self.blocks))
        m = len(self.vocabulary)
        first = _lists(term, m)
        self.rest = np.zeros(self.blocks)
        read = np.ones(m, bool)
        for t in np.argsort(-np.diff(first), kind="stable").tolist():  # the longest lists first
            lo, hi = first[t], first[t + 1]
            if hi - lo < 2:
                break
            more = self.rest[block[lo:hi]] + most[lo:hi]
            if more.max() <= SKIPPED * THRESHOLD:
                self.rest[block[lo:hi]] = more
                read[t] = False
        keep = read[term]
        self.first = _lists(term[keep], m + 1).astype(np.int64)
        self.block, self.most = block[keep].astype(np.int32), most[keep]

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each term in the vocabulary; its length for terms that no item has."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == h, at, len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(h), np.int64)


def retrieve(index: Index, h: np.ndarray, first: np.ndarray, threshold: float):
    """(row, passage start, passage end, unit, score) of all passages of the rows of terms h.

    A passage is two strides; the sums of block maxima are taken by stride, over its distinct terms.
    """
    place = index.places(h)
    m = len(index.vocabulary)
    known = np.flatnonzero(place < m)
    if not len(known):
        return
    size = np.diff(first)
    strides = -(-size // STRIDE)
    before = np.cumsum(strides) - strides
    row_of = np.repeat(np.arange(len(size)), strides)
    last = np.zeros(len(row_of) + 1, bool)
    last[(before + strides - 1)[strides > 0]] = True
    row = np.searchsorted(first, known, "right") - 1
    stride = before[row] + (known - first[row]) // STRIDE
    pair = np.unique(stride * (m + 1) + place[known])
    stride, term = np.divmod(pair, m + 1)
    mark = np.zeros(m + 1, bool)
    step = max(1, CELLS // index.blocks)
    for at in range(0, len(row_of), step):
        to = min(len(row_of), at + step)
        lo, hi = np.searchsorted(stride, [at, to + 1])
        n = index.first[term[lo:hi] + 1] - index.first[term[lo:hi]]
        where = _ranges(index.first[term[lo:hi]], n)
        sums = np.bincount(np.repeat(stride[lo:hi] - at, n) * index.blocks + index.block[where], index.most[where], (to + 1 - at) * index.blocks).reshape(-1, index.blocks)
        bound = sums[:-1] + np.where(last[at:to, None], 0, sums[1:]) + index.rest
        s, b = np.nonzero(bound >= threshold * 0.999)
        if not len(s):
            continue
        cut = np.flatnonzero(np.diff(s, prepend=-1))
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(s)).tolist(), strict=True):
            x = int(s[i]) + at
            if last[x] and x > before[row_of[x]]:
                continue  # the passage before ends with this stride
            lo, hi = np.searchsorted(stride, [x, x + 1 if last[x] else x + 2])
            mark[term[lo:hi]] = True
            blocks = b[i:j].astype(np.int64)
            unit = _ranges(blocks * BLOCK, np.full(len(blocks), BLOCK))
            n = index.unit_first[unit + 1] - index.unit_first[unit]
            where = _ranges(index.unit_first[unit], n)
            score = np.bincount(np.repeat(np.arange(len(unit)), n), index.unit_impact[where] * mark[index.unit_place[where]], len(unit))
            mark[term[lo:hi]] = False
            r = int(row_of[x])
            start = int(first[r]) + (x - int(before[r])) * STRIDE
            for k in np.flatnonzero(score >= threshold).tolist():
                yield r, start, min(start + PASSAGE, int(first[r + 1])), int(unit[k]), float(score[k])


def _share(part: np.ndarray, have: np.ndarray) -> float:
    return float(np.isin(part, have).mean()) if len(part) else 0.0


def contaminated(index: Index, batch: pa.RecordBatch, threshold: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question share, answer share) of the items that a text contains."""
    data, off = spread(batch.column("text"))
    out = []
    for i, j in T.groups(off):
        w = T.words(data, off, i, j, T.TERM_BYTES, T.LOWER_VALUES)
        scores: dict[tuple[int, int, int, int], float] = {}
        for r, a, b, x, score in retrieve(index, w.hashes, w.first, threshold):
            key = (r, int(index.item[x]), a, b)
            scores[key] = max(score, scores.get(key, 0.0))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for (r, x, a, b), score in scores.items():
            if score <= best.get((r, x), (0.0,))[0]:
                continue
            beside = max(PASSAGE, int(index.sizes[x]))
            terms = w.hashes[max(w.first[r], a - beside) : min(w.first[r + 1], b + beside)]
            near = {k: np.unique(T.shingles(terms, k)) for k in {k for k, _ in index.grams[x] if k}}
            whole, q, s = (_share(g, near[k]) if k else 0.0 for k, g in index.grams[x])
            if (q >= QUESTION and index.alone[x]) or (s >= ANSWER and whole >= WHOLE):
                best[r, x] = (score, q, s)
        out += [(i + r, int(index.ids[x]), *v) for (r, x), v in sorted(best.items())]
    return out


def build_index(items: DataFrame, id_column: str = "item_id") -> list[DataFrame]:
    """The index of the items (item_id, text), a table (shard, data) for each shard; items without text or id are left out."""
    scratch = Scratch(items.sparkSession, "benchmark")
    items = items.where(F.col("text").isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("i"), "text").dropDuplicates(["i"])
    items = scratch.table(items, "items")

    def f(batches):
        for batch in batches:
            terms = _terms(batch.column("text").to_pylist())
            shard = batch.column("shard").to_numpy()
            for k in np.unique(shard).tolist():
                own = [t for t, s in zip(terms, shard.tolist(), strict=True) if s == k]
                u = np.concatenate([*(np.unique(t) for t in own), np.zeros(0, U64)])
                h, df = np.unique(u, return_counts=True)
                yield T.rows(shard=np.full(len(h), k, np.int32), h=T.signed(h), df=df.astype(np.int64), size=np.where(np.arange(len(h)) == 0, sum(map(len, own)), 0))

    schema = "shard int, h long, df long, size long"
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    shards = max(1, -(-n // SHARD), -(-(chars or 0) // (4 * SHARD_TERMS)))
    items = items.withColumn("shard", F.pmod(F.xxhash64("i"), F.lit(shards)).cast("int"))
    counted = scratch.table(items.select("shard", "text").mapInArrow(f, schema), "terms")
    mean = max(1.0, (counted.agg(F.sum("size")).first()[0] or 0) / max(1, n))
    own = counted.select("shard", "h").distinct().join(counted.groupBy("h").agg(F.sum("df").alias("df")), "h")

    def built(_, rows, terms):
        df = dict(zip(terms.column("h").to_numpy().view(U64).tolist(), terms.column("df").to_pylist(), strict=True))
        pairs = sorted(zip(rows.column("i").to_pylist(), rows.column("text").to_pylist(), strict=True))
        return pa.table({"shard": rows.column("shard").slice(0, 1), "data": pa.array([pickle.dumps(Index(pairs, n, df, mean), 5)], pa.binary())})

    made = items.groupBy("shard").cogroup(own.select("shard", "h", "df").groupBy("shard")).applyInArrow(built, "shard int, data binary")
    made = scratch.table(made.where("shard is not null"), "index")
    return [made.where(F.col("shard") == k) for k in range(shards)]


def _sent(docs: DataFrame, index: list[DataFrame]):
    """A broadcast of each shard that has items."""
    for shard in index:
        row = shard.first()
        if row is not None:
            yield docs.sparkSession.sparkContext.broadcast(bytes(row["data"]))


def benchmark_matches(docs: DataFrame, index: list[DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the test items that each of docs (doc_id, text, ...) contains.

    A pair is there when an item, its question or its answer is retrieved for a passage, and the
    passage with its surroundings has 0.6 of the question's n-grams, or 0.6 of the answer's and half
    of the whole item's.  A part of fewer than NGRAM terms is one n-gram of its own length.  A question
    with fewer than LEAST words that tell something (see telling) doesn't decide alone.  In scripts without spaces each letter is a term.  score is the best of the units.  Null and empty texts, and texts
    without letters or digits, contain none.  Repeated rows are reported alike.  Other columns are
    ignored; an empty table of items or documents gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for shared in _sent(docs, index):

        def f(batches, shared=shared):
            shard = pickle.loads(shared.value)
            for batch in batches:
                found = contaminated(shard, batch, threshold)
                if found:
                    r, i, s, q, a = zip(*found, strict=True)
                    yield T.rows(doc_id=batch.column("doc_id").take(pa.array(r)), item_id=pa.array(i, pa.int64()), score=pa.array(s), question_overlap=pa.array(q), answer_overlap=pa.array(a))

        part = docs.mapInArrow(f, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove_contaminated(docs: DataFrame, index: list[DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (text, ...) whose text contains no test item, with their columns, whatever those are named.

    Null and empty texts stay.  Repeated rows stay or go alike.  Empty tables of documents or items remove nothing.
    """
    for shared in _sent(docs, index):

        def f(batches, shared=shared):
            shard = pickle.loads(shared.value)
            for batch in batches:
                gone = {r for r, *_ in contaminated(shard, batch, threshold)}
                yield batch.filter(pa.array([r not in gone for r in range(len(batch))], pa.bool_()))

        docs = docs.mapInArrow(f, docs.schema)
    return docs
