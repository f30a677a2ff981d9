"""Personal data: fixed rules, and bootstrapped contextual extraction around what they find.

The rules find e-mail and IP addresses, card and phone numbers.  Tokens that look like identifiers
(long enough, with several digits) are candidates.  A candidate stands in lexical patterns: the word
before it, the word after it, a key joined to it (``key=``, ``key: ``) and its own shape.  Spark
scores the graph of patterns and instances iteratively: seeds have confidence 1; a
pattern's score is the smoothed mean confidence of its instances; an instance believes its best
patterns.  Candidates of patterns whose score is high enough become spans of the kind ``id``.

Seeds are the rules' finds, access keys of a well-known form, and values that are assigned to a name
such as ``password`` or ``token``; the latter two are spans of the kind ``id`` themselves.  What a
rule matched and then refused, such as a number that fails the check digit, is no candidate.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import Scratch

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SMOOTHING = 2.0  # imaginary instances of confidence 0 in each pattern
HIGH = 0.7  # score of a pattern that may extract
LEAST_VALUE = 6  # characters of a value assigned to a name
LEAST_TOKEN, LEAST_DIGITS = 8, 4  # characters and digits of a candidate
LONG = 256  # characters beyond which an instance is named by its digest

_HINT = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_BREAKS = " \t\n\v\f\r=:\"'"  # between the pieces of text that may be identifiers
_REST = re.compile(r"[^\x20\x09-\x0D=:\"']*")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_NAMED = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api_?key|access_?key)\x20{0,2}[=:]\x20{0,2}[\"']?([^\x20\x09-\x0D\"']{6,})")
_ACCESS_KEY = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the rules' finds, by kind and then start; spans that a rule refused."""
    out, refused = [], []
    end, at = 0, text.find("@")
    while at >= 0:  # an address has one @: its name is the run before it, its domain follows
        lo = at
        while lo > end and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            out.append(("email", lo, end))
        at = text.find("@", max(end, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
        else:
            refused.append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            if _luhn(digits):
                out.append(("card", *m.span()))
            else:
                refused.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
            else:
                refused.append(m.span())
    return out, refused


def _shape(token: str) -> str:
    """Character classes of a token: hexadecimal, digits, letters and digits, or as punctuated."""
    size = len(token)
    token = token[:LONG]
    kinds = re.sub(r"[0-9]+", "9", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", token)))
    if re.fullmatch(r"[0-9a-f]+", token) and "a" in kinds and "9" in kinds:
        kinds = "hex"
    elif re.fullmatch(r"[0-9A-Za-z]+", token) and len(kinds) > 2:
        kinds = "mixed"
    return f"{kinds[:40]}/{min(size, 64) // 4}"


class Taken:
    """Disjoint spans in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def left(self, a: int, b: int) -> list[tuple[int, int]]:
        """The parts of a..b that no span has."""
        out = []
        i = bisect.bisect_right(self.ends, a)
        while i < len(self.starts) and self.starts[i] < b:
            if self.starts[i] > a:
                out.append((a, self.starts[i]))
            a = self.ends[i]
            i += 1
        return [*out, (a, b)] if a < b else out

    def add(self, a: int, b: int) -> None:
        """Takes a span that is free."""
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Pieces without white space, quotes, = and : that hold a digit, cut to where ASCII letters and digits begin and end; in linear time."""
    end = 0
    while m := _DIGIT.search(text, end):
        lo = max(end, *(text.rfind(x, end, m.start()) + 1 for x in _BREAKS))
        end = hi = _REST.match(text, m.end()).end()
        while text[lo] not in _ALNUM:
            lo += 1
        while text[hi - 1] not in _ALNUM:
            hi -= 1
        yield lo, hi


def candidates(text: str, base: list[tuple[str, int, int]], refused: list[tuple[int, int]]) -> list[tuple[int, int, bool, bool, str, list[str]]]:
    """(start, end, base, seed, instance, patterns) of seeds and of tokens that look like identifiers."""
    spans = [(a, b, True, True) for _, a, b in base]
    taken = Taken([(a, b) for _, a, b in base] + refused)
    for m in (*_NAMED.finditer(text), *_ACCESS_KEY.finditer(text)):
        whole = m.span(m.lastindex or 0)
        free = taken.left(*whole)
        if free != [whole]:  # of a named value, what rules leave of it, if long enough
            free = [x for x in free if x[1] - x[0] >= LEAST_VALUE] if m.lastindex else []
        for a, b in free:
            spans.append((a, b, False, True))
            taken.add(a, b)
    for a, b in _tokens(text):
        if b - a >= LEAST_TOKEN and sum(map(text.count, "0123456789", [a] * 10, [b] * 10)) >= LEAST_DIGITS and taken.left(a, b) == [(a, b)]:
            spans.append((a, b, False, False))
    out = []
    for a, b, rule, seed in spans:
        before = _WORD.findall(text[max(0, a - 64) : a])
        after = _WORD.search(text, b, b + 64)
        token = text[a:b]
        patterns = [f"shape {_shape(token)}"]
        glued = bool(a) and text[a - 1] not in " \t\n\v\f\r"
        if glued or (before and before[-1][-1] in "=:"):
            patterns.append(f"key {' '.join(before[-1 if glued and len(before[-1]) > 1 else -3 :]).lower()}")
        elif before:
            patterns.append(f"before {before[-1].lower()}")
        if after and after.start() > b:
            patterns.append(f"after {after.group().lower()}")
        out.append((a, b, rule, seed, token if b - a <= LONG else f"sha256 {hashlib.sha256(token.encode()).hexdigest()}", patterns))
    return out


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, found array<struct<lo:int,hi:int,rule:boolean,seed:boolean,instance:string,patterns:array<string>>>"
_FOUND_TYPE = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("rule", pa.bool_()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _scan(batches):
    nothing = hashlib.sha256(b"").hexdigest()
    for whole in batches:
        for at in range(0, len(whole), 500):
            batch = whole.slice(at, 500)
            n = {k: [] for k in KINDS}
            joined, digest, found = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base, refused = base_spans(text) if _HINT.search(text) else ([], [])
                for k in KINDS:
                    n[k].append(sum(x[0] == k for x in base))
                s = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                joined.append(s)
                digest.append(hashlib.sha256(s.encode()).hexdigest() if s else nothing)
                names = ("lo", "hi", "rule", "seed", "instance", "patterns")
                found.append([dict(zip(names, x, strict=True)) for x in candidates(text, base, refused)])
            yield T.rows(doc_id=batch.column("doc_id"), **{f"n_{k}": pa.array(n[k], pa.int64()) for k in KINDS}, base=pa.array(joined, pa.string()), base_sha256=pa.array(digest, pa.string()), found=pa.array(found, _FOUND_TYPE))


def pattern_scores(scratch: Scratch, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score) from edges (instance, seed, pattern), one row an occurrence.

    An instance is one string, seed if it is a seed anywhere.  Its confidence is 1 for a seed, else
    that of 1 - (1 - best) * (1 - second best) of its pattern scores.
    """
    edges = scratch.table(edges.groupBy("instance", "pattern").agg(F.max("seed").alias("seed")), "edges")
    instances = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("confidence"))
    for _ in range(rounds):
        scores = edges.join(instances, "instance").groupBy("pattern").agg((F.sum("confidence") / (F.count(F.lit(1)) + SMOOTHING)).alias("score"))
        scores = scratch.table(scores, "scores")
        best = edges.join(scores, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), F.max("score").alias("a"), (F.sum("score") - F.max("score")).alias("b"))
        instances = best.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - (1 - F.col("a")) * (1 - F.least("b", F.lit(1.0)))).alias("confidence"))
    return scores


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, high: float = HIGH) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans) for each row of docs (doc_id, text, ...).

    spans lists kind:start:end, joined by commas: the rules' finds by kind and start, then those of
    the method as kind id.  n_id counts the latter, n_spans all.  Offsets count code points, the end is exclusive.  A null text is empty;
    an empty text has no spans.  Rows without doc_id and repeated rows are treated like others.
    Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _FOUND).withColumn("row", F.monotonically_increasing_id())
    scanned = scratch.table(scanned, "scanned")
    each = scanned.where("size(found) > 0").select("row", F.explode("found").alias("x")).select("row", "x.*")
    edges = each.select(F.col("instance"), "seed", F.explode("patterns").alias("pattern"))
    scores = pattern_scores(scratch, edges, rounds).where(F.col("score") >= high).select("pattern")
    more = each.where("not seed").select("row", "lo", "hi", F.explode("patterns").alias("pattern")).join(scores, "pattern").select("row", "lo", "hi")
    more = more.unionByName(each.where("seed and not rule").select("row", "lo", "hi")).distinct()
    more = more.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("more"))
    more = more.select("row", F.size("more").cast("long").alias("n_id"), F.concat_ws(",", F.transform("more", lambda x: F.concat_ws(":", F.lit("id"), x["lo"], x["hi"]))).alias("more"))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more")
    n_id = F.coalesce("n_id", F.lit(0).cast("long"))
    n_spans = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + n_id
    return scanned.drop("found").join(more, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), n_id.alias("n_id"), n_spans.alias("n_spans"))
