"""Periodic runs of words in a text, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q, at least ``times`` periods and ``least`` words
long, that no neighbouring word extends.  The text is factorised so that each factor is the longest
that begins earlier, too (or a word met first), read off a suffix automaton.  A run either touches or crosses a
factor's border, where Main's algorithm finds it by longest common extensions, or lies strictly
inside a factor, and then is a copy of an earlier run, moved by the distance of the factor's earlier occurrence.

A word of a run is in a window of ``window`` words that the text repeats, window being the fewest
words that a run has in common with itself moved by its period.  Windows are compared by hash for
many texts at once, and only stretches that repeated windows cover are factorised, each by itself;
no run can reach beyond one, so that none is lost.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

Run = tuple[int, int, int]  # start, end, period


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1) of each factor of w, whose letters are from 0.

    The suffix automaton holds one transition of each state in arrays, and further ones in a dict.
    """
    length, link, end, letter, to = (array("q", [x]) for x in (0, -1, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(w):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        letter.append(-1)
        to.append(-1)
        p, last = last, new
        q = -1
        while p >= 0:
            x = letter[p]
            if x == c:
                q = to[p]
                break
            if x < 0:
                letter[p], to[p] = c, new
            elif (m := more.get(p)) is None:
                more[p] = {c: new}
            elif c in m:
                q = m[c]
                break
            else:
                m[c] = new
            p = link[p]
        if q < 0:
            continue
        if length[p] + 1 == length[q]:
            link[new] = q
            continue
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        end.append(end[q])
        letter.append(letter[q])
        to.append(to[q])
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if letter[p] == c:
                if to[p] != q:
                    break
                to[p] = copy
            elif (m := more.get(p)) is not None and m.get(c) == q:
                m[c] = copy
            else:
                break
            p = link[p]
        link[q] = link[new] = copy
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            c = w[j]
            t = to[state] if letter[state] == c else more[state][c]
            if end[t] >= j:  # its first occurrence is this one
                break
            state, j = t, j + 1
        out.append((i, j, end[state] - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = out[-1][1]
    return out


def _z(x: list[int]) -> list[int]:
    """How many letters each suffix has in common with the whole."""
    n = len(x)
    z, lo, hi = [n] * n, 0, 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def _at_border(w: list[int], a: int, b: int, e: int, least: int, times: int) -> dict[tuple[int, int], int]:
    """Runs (start, end): period with a < end <= e that touch or cross b, the border of the factors [a, b) and [b, e).

    A run over b that ends beyond it begins less than a period before a, since else the factor at a
    would have gone on to the run's end; so (times - 1) * q is at most e - a.  Runs that end at b
    count only if they begin after a: the others are found at a.
    """
    most = (e - a) // (times - 1)
    lo, hi = max(0, a - most - 1), min(len(w), e + 1)
    right, left = min(most, e - b), min(most, b - lo)
    head, tail = w[b:hi], w[lo:b][::-1]
    forth = _z([*head, -1, *w[b - left : hi]])  # against what begins at b
    back = _z([*tail, -1, *w[lo : b + right][::-1]])  # against what ends at b
    f, g = len(head) + 1 + left, len(tail) + 1 + right
    out: dict[tuple[int, int], int] = {}
    for q in range(1, most + 1):
        if q <= right:  # a period beyond b
            s, t = b - back[g - q], b + q + (forth[q] if q < len(head) else 0)
            if t - s >= max(least, times * q) and t <= e:
                out.setdefault((s, t), q)
        if q <= left:  # a period before b
            s, t = b - q - (back[q] if q < len(tail) else 0), b + forth[f - q]
            if t - s >= max(least, times * q) and t <= e and (t > b or s > a):
                out.setdefault((s, t), q)
    return out


def runs_of(w: list[int], least: int = 24, times: int = 3) -> list[Run]:
    """The runs (start, end, period) of w, sorted."""
    found: list[Run] = []
    a = b = 0
    for b, e, source in [*factors(w), (len(w), len(w), -1)]:
        if (e - a) * times >= least * (times - 1):  # else no run there is long enough
            for (s, t), q in _at_border(w, a, b, e, least, times).items():
                insort(found, (s, t, q))
        if source >= 0:
            moved, at = b - source, bisect_left(found, (source + 1, 0, 0))
            while at < len(found) and found[at][0] + moved + least < e:  # copies come behind what they are copied from
                s, t, q = found[at]
                if t + moved < e:
                    insort(found, (s + moved, t + moved, q))
                at += 1
        a = b
    return found


def least_window(least: int, times: int) -> int:
    """The fewest words that a run has in common with itself moved by its period."""
    return -(-least * (times - 1) // times)


def word_runs(h: np.ndarray, least: int = 24, times: int = 3) -> list[Run]:
    """The runs of a text with the word hashes h."""
    k = least_window(least, times)
    if len(h) < least:
        return []
    windows = T.shingles(h, k)
    order = np.argsort(windows, kind="stable")
    same = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
    if not len(same):
        return []
    edge = np.zeros(len(h) + 1, np.int64)
    repeated = np.unique(np.concatenate([order[same], order[same + 1]]))
    edge[repeated] += 1
    edge[repeated + k] -= 1
    covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    cuts = np.flatnonzero(covered[1:] != covered[:-1])
    out = []
    for lo, hi in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
        if hi - lo >= least:
            letters = np.unique(h[lo:hi], return_inverse=True)[1].tolist()
            out += [(s + lo, t + lo, q) for s, t, q in runs_of(letters, least, times)]
    return out


def _strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length in periods; of equal ones the first, then that of the smallest period."""
    best = None
    for s, t, q in runs:
        if best is None or (t - s) * best[2] > (best[1] - best[0]) * q:
            best = s, t, q
    return best


def _documents(least: int, times: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in T.groups(off, 8 * T.PIECE):
                x = T.words(data, off, i, j)
                n_words, every, best, texts = [], [], [], []
                for r in range(i, j):
                    lo, hi = x.first[r - i], x.first[r - i + 1]
                    runs = word_runs(x.hashes[lo:hi], least, times)
                    every.append([{"start": s, "length": t - s, "period": q} for s, t, q in sorted(runs, key=lambda z: (z[0], z[2]))])
                    n_words.append(int(hi - lo))
                    top = _strongest(sorted(runs, key=lambda z: (z[0], z[2])))
                    best.append({"start": top[0], "length": top[1] - top[0], "period": top[2]} if top else None)
                    words = data[off[r] : off[r + 1]].tobytes().split()
                    if runs:
                        keep = np.ones(len(words), bool)
                        for s, t, q in runs:
                            keep[s + q : t] = False
                        words = [words[z] for z in np.flatnonzero(keep).tolist()]
                    texts.append(b" ".join(words))
                run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                yield T.rows(doc_id=ids.slice(i, j - i), n_words=pa.array(n_words, pa.int64()), runs=pa.array(every, pa.list_(run)), strongest=pa.array(best, run), collapsed=pa.array(texts, pa.binary()).cast(pa.string()))

    return f


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) for each row of docs (doc_id, text, ...).

    runs: the text's runs (start in words from 0, length, period) by start, then period.  strongest: that of the
    greatest length in periods (ties: the first, then the smallest period), null without runs.
    collapsed: the text without the words that a run has after its first period, joined by one space.
    A null, empty or blank text has no words and no runs, and collapses to an empty text.  Repeated
    rows and rows without doc_id are each returned; other columns are ignored, whatever their names;
    an empty table gives an empty result.  No row leaves its task: there is no shuffle.  A text is
    held whole, at some 30 bytes a word, and the automaton at some 100 a word of a repeated stretch.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_documents(least, times), f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")
