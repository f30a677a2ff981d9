"""Language identification by a byte convolutional network.

A window of WINDOW bytes is embedded byte by byte and convolved with filters of several widths; the
greatest response of each filter goes through a softmax over the languages.  The network is trained
in numpy on a bounded sample of labelled texts and applied to the windows of every text in batches:
consecutive windows cover the whole text, and their log-probabilities, weighted by the letters that
they hold, are summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBED = 6
TRAIN_DOCS = 800  # of each language
TRAIN_ALL = 160_000  # of all languages, which share it equally when they are more than 200
TRAIN_WINDOWS = 3  # of each document
UNKNOWN = "und"

#: Bytes of letters: ASCII letters, and whatever begins or continues a non-ASCII character.
_LETTER = np.zeros(256, np.float32)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 0.5


class Network:
    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        n, wide = FILTERS * len(WIDTHS), max(WIDTHS)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((wide, EMBED, n), np.float32)
        for i, w in enumerate(WIDTHS):  # narrower filters see the first bytes only
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(wide * EMBED, n)
        self.conv = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.out = np.zeros(len(languages), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]  # windows, bytes, EMBED
        wide = max(WIDTHS)
        m, n = e.shape[0], e.shape[1] - wide + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (m, n, wide * EMBED), (s[0], s[1], s[2])).reshape(m * n, -1)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self._columns(x)
        z = (c @ self.conv).reshape(len(x), -1, self.conv.shape[1])
        return z, c

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z, _ = self.pooled(x)
        h = np.maximum(z.max(1) + self.bias, 0)
        y = h @ self.dense + self.out
        y -= y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, size: int = 64, rate: float = 0.01, seed: int = 4) -> None:
        """Adam over the cross-entropy of the windows x (byte values) with the languages y."""
        rng = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "dense", "out")
        m1 = {k: np.zeros_like(getattr(self, k)) for k in names}
        m2 = {k: np.zeros_like(getattr(self, k)) for k in names}
        wide, step = max(WIDTHS), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), size):
                b = order[at : at + size]
                z, c = self.pooled(x[b])
                top = z.argmax(1)
                a = np.take_along_axis(z, top[:, None], 1)[:, 0] + self.bias
                h = np.maximum(a, 0)
                o = h @ self.dense + self.out
                p = np.exp(o - o.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(b)), y[b]] -= 1
                p /= len(b)
                da = (p @ self.dense.T) * (a > 0)
                # only the place of each maximum passes a gradient on
                positions = z.shape[1]
                cols = c.reshape(len(b), positions, -1)[np.arange(len(b))[:, None], top]  # windows, filters, wide*EMBED
                dconv = np.einsum("bf,bfe->ef", da, cols) * self.mask
                dcols = (da[:, :, None] * self.conv.T[None]).reshape(len(b), -1, wide, EMBED)
                byte = x[b][np.arange(len(b))[:, None, None], top[:, :, None] + np.arange(wide)]
                dembed = np.zeros_like(self.embed)
                np.add.at(dembed, byte.ravel(), dcols.reshape(-1, EMBED))
                dembed[0] = 0
                step += 1
                for k, g in (("embed", dembed), ("conv", dconv), ("bias", da.sum(0)), ("dense", h.T @ p), ("out", p.sum(0))):
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    v = getattr(self, k)
                    v -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _windows(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover the rows i..j, padded with zeros, and the row of each."""
    size = off[i + 1 : j + 1] - off[i:j]
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(i, j), count)
    first = np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(off[i:j], count) + (np.arange(len(row)) - first) * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < np.repeat(off[i + 1 : j + 1], count)[:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], 0), row


def _predict(net: Network, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    data, off = T.buffers(batch.column("text"))
    n = len(batch)
    total, letters, ascii_letters = np.zeros((n, len(net.languages))), np.zeros(n), np.zeros(n, bool)
    for i, j in T.groups(off, 1 << 16):
        x, row = _windows(data, off, i, j)
        for at in range(0, len(x), 256):
            w, r = x[at : at + 256], row[at : at + 256]
            weight = _LETTER[w].sum(1)
            np.add.at(total, r, net.log_probabilities(w) * weight[:, None])
            np.add.at(letters, r, weight)
            np.logical_or.at(ascii_letters, r, (_LETTER[w] == 1).any(1))
    mean = total / np.maximum(letters, 1)[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    lettered = _has_letters(batch.column("text"), letters, ascii_letters)
    return [net.languages[b] if k else UNKNOWN for b, k in zip(best, lettered, strict=True)], np.where(lettered, p.max(1), 0.0)


def _has_letters(column: pa.Array, weight: np.ndarray, ascii_letters: np.ndarray) -> np.ndarray:
    """Whether a text has a letter; those that have no ASCII letter but other characters are looked at, whatever their length."""
    out = ascii_letters.copy()
    for r in np.flatnonzero(~out & (weight > 0)).tolist():
        out[r] = any(c.isalpha() for c in column[r].as_py() or "")
    return out


def fit_languages(docs: DataFrame, rows: int = TRAIN_DOCS) -> Network | None:
    """Learns from at most about ``rows`` texts of each language, and TRAIN_ALL in all, chosen by the hash of doc_id.

    docs (doc_id, text, lang, ...); rows without text or lang teach nothing, of several rows of one
    document the least (lang, text) does.  Other columns are ignored.  None if nothing can be learned.
    """
    docs = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id", F.lit(3)).alias("key"))
    count = docs.groupBy("lang").count().collect()
    if not count:
        return None
    languages = sorted(r["lang"] for r in count)
    rows = min(rows, max(1, TRAIN_ALL // len(count)))
    share = F.create_map(*[F.lit(x) for r in count for x in (r["lang"], min(1.0, rows / r["count"]))])
    sample = docs.where((F.shiftrightunsigned("key", 11) / float(1 << 53)) < share[F.col("lang")])
    sample = sample.groupBy("key").agg(F.min(F.struct("lang", "text")).alias("x")).select("x.*", "key")

    def f(batches):
        for batch in batches:
            data, off = T.buffers(batch.column("text"))
            key, lang = batch.column("key").to_pylist(), batch.column("lang").to_pylist()
            out = []
            for r in range(len(batch)):
                if off[r + 1] > off[r]:
                    x, _ = _windows(data, off, r, r + 1)
                    pick = np.unique(np.random.default_rng(key[r] & 0xFFFFFFFF).integers(0, len(x), TRAIN_WINDOWS))
                    out += [(key[r], lang[r], w.tobytes()) for w in x[pick] if _LETTER[w].any()]
            if out:
                k, t, w = zip(*out, strict=True)
                yield T.rows(key=pa.array(k, pa.int64()), lang=pa.array(t, pa.string()), window=pa.array(w, pa.binary()))

    found = sample.select("text", "lang", "key").mapInArrow(f, "key long, lang string, window binary").toArrow()
    rows_ = sorted(zip(*(found[c].to_pylist() for c in ("key", "lang", "window")), strict=True))
    if not rows_:
        return None
    net = Network(languages)
    x = np.frombuffer(b"".join(w for _, _, w in rows_), np.uint8).reshape(-1, WINDOW)
    place = {v: i for i, v in enumerate(languages)}
    y = np.array([place[v] for _, v, _ in rows_])
    cut = np.random.default_rng(9).random(len(x)) < 0.3  # short texts: some windows are cut and padded
    x = np.where(cut[:, None] & (np.arange(WINDOW) >= 40), 0, x)
    net.train(x, y)
    return net


def predict_languages(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs (text, ...) with lang_pred and score (0 to 1); a text that is null or has no letter is ``und`` with score 0.

    Other columns pass through; those named lang_pred and score are replaced.  Repeated rows are
    predicted alike, an empty table stays empty.  Without a network every text is ``und``.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def f(batches):
        for batch in batches:
            if shared.value is None:
                pred, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            else:
                pred, score = _predict(shared.value, batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.asarray(score, np.float64))], names=[*batch.schema.names, "lang_pred", "score"])

    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(f, schema)
