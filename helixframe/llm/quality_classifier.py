"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A text's features are its words and pairs of words, hashed to 2**BITS places; a pair of equal words
is one common feature.  A feature's value is its count over the root of all counts.  Training takes
a bounded sample of the labelled rows (TRAIN_ROWS); scoring takes every word of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

U64 = np.uint64
BITS = 18
TRAIN_ROWS = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
_Q = U64(0x9DDFEA08EB382D69)
_SAME = U64(0xB492B66FBE98F273)


def _places(batch: pa.RecordBatch):
    """(row, places of all its features) for each row with words."""
    data, off = T.buffers(batch.column("text"))
    shift = U64(64 - BITS)
    for i, j in T.groups(off):
        w = T.words(data, off, i, j)
        h = w.hashes
        pair = T.mix(h[:-1] * _Q + h[1:]) if len(h) else h
        pair[h[:-1] == h[1:]] = _SAME
        one, two = (h >> shift).astype(np.int64), (pair >> shift).astype(np.int64)
        for r in range(i, j):
            a, b = w.first[r - i], w.first[r - i + 1]
            if b > a:
                yield r, np.concatenate([one[a:b], two[a : b - 1]])


class Model:
    """Weights and bias; score() gives the probability of label 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.full(len(batch), self.bias)
        for r, x in _places(batch):
            out[r] += self.weights[x].sum(dtype=np.float64) / np.sqrt(len(x))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """examples: (places, counts, label), in the order in which they are learned; a value is the count over the root of the text's counts."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for places, counts, label in examples:
            at, x = np.append(places, bias), np.append(counts / np.sqrt(counts.sum()), 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -50, 50)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    return Model(w[:bias].astype(np.float32), float(w[bias]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``rows`` of the labels, chosen by the hash of doc_id; the caller leaves out those held out.

    Labels that are null, and rows without doc_id, teach nothing; of several labels of one document
    the least counts, of several texts the least by code point.  Other columns are ignored.  Without
    labels the model gives every text 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    n = known.count()
    order = F.xxhash64("doc_id", F.lit(5))
    if n > rows:
        known = known.where(F.shiftrightunsigned(order, 1) < int((1 << 63) * min(1.0, 1.2 * rows / n)))
    known = known.orderBy(order, "doc_id").limit(rows)

    def features(batches):
        for batch in batches:
            label, key = batch.column("label").to_pylist(), batch.column("key").to_pylist()
            found = [(r, *np.unique(x, return_counts=True)) for r, x in _places(batch)]
            if found:
                yield T.rows(
                    key=pa.array([key[r] for r, _, _ in found], pa.int64()),
                    label=pa.array([label[r] for r, _, _ in found], pa.int32()),
                    places=pa.array([p.astype(np.int32).tobytes() for _, p, _ in found], pa.binary()),
                    counts=pa.array([c.astype(np.int32).tobytes() for _, _, c in found], pa.binary()),
                )

    # one text a label, however many rows the document has
    rows_ = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows_ = rows_.select(F.xxhash64("doc_id", F.lit(6)).alias("key"), "label", "text")
    found = rows_.mapInArrow(features, "key long, label int, places binary, counts binary").toArrow()
    taken = sorted(zip(*(found[c].to_pylist() for c in ("key", "label", "places", "counts")), strict=True))
    del found
    examples = [(np.frombuffer(p, np.int32), np.frombuffer(c, np.int32), y) for _, y, p, c in taken]
    return train_ftrl(examples)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with quality_score, the probability of label 1; a null or blank text gets that of the bias.

    Other columns pass through; one named quality_score is replaced.  Repeated rows score alike, an
    empty table stays empty.
    """
    docs = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch))], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(f, docs.withColumn("quality_score", F.lit(0.0)).schema)


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs (text, ...) that score at least the threshold, with their columns, whatever those are named.

    Null and blank texts score as the bias does.  Repeated rows stay or go alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch) >= threshold))

    return docs.mapInArrow(f, docs.schema)
