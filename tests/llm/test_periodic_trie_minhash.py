"""Periodic runs, the conversation trie and MinHash near-dedup against brute force and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from helixframe.llm import conversation_trie, minhash, periodic_runs, queries, shared, skew
from helixframe.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n string, d1 long, root long, hash string, runs string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z") for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], DOCS)


# periodic runs


def brute_runs(w, least, times):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, t = i, j + q
            if t - s >= max(least, times * q) and not any(w[s : t - p] == w[s + p : t] for p in range(1, q)):
                out.append((s, t, q))
            i = j
    return sorted(out)


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        n, k = rng.randrange(60), rng.choice((1, 2, 2, 3, 5))
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 6:
            p = rng.randrange(1, n // 3 + 1)
            a = rng.randrange(n - 3 * p + 1)
            for i in range(a + p, min(n, a + rng.randrange(3, 6) * p)):
                w[i] = w[i - p]
        if rng.random() < 0.3:
            w = w + w[: rng.randrange(n + 1)] + [9] + w
        times = rng.choice((2, 3, 3, 4))
        least = rng.choice((times, 4, 6, 9))
        assert periodic_runs.runs_of(w, least, times) == brute_runs(w, least, times)
        hashes = T.mix(np.array(w, np.uint64) + np.uint64(1))
        least = max(least, times)
        assert sorted(periodic_runs.word_runs(hashes, least, times)) == brute_runs(w, least, times)


def test_periodic_documents(spark):
    rng = random.Random(4)
    rep = lambda p, n: [f"p{i % p}" for i in range(n)]
    texts = [None, "", " \n\t", "one", " ".join(rep(7, 40) + ["x"] + rep(3, 23) + ["y"] + rep(2, 24)), " ".join(["a"] * 24), " ".join(["a"] * 24), "\n".join(rep(8, 24)) + "\x0b", "Étion " * 50_000]
    texts.append(" ".join(rng.choice("ab") for _ in range(3000)))
    texts.append(" ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000)))  # long, without a run
    rows = periodic_runs.periodic_runs(docs_of(spark, texts, [*range(len(texts) - 1), None])).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) and got[None]["runs"] == [] and got[None]["strongest"] is None
    for i, t in enumerate(texts[:-2]):
        words = WORD.findall(t or "")
        want = brute_runs(words, 24, 3) if len(words) < 10_000 else [(0, len(words), 1)]
        assert [(r["start"], r["start"] + r["length"], r["period"]) for r in got[i]["runs"]] == want and got[i]["n_words"] == len(words)
        gone = {x for s, e, q in want for x in range(s + q, e)}
        assert got[i]["collapsed"] == " ".join(x for k, x in enumerate(words) if k not in gone)
    best = got[4]["strongest"]
    assert (best["start"], best["length"], best["period"]) == (65, 24, 2)
    assert periodic_runs.periodic_runs(docs_of(spark, [])).count() == 0


def test_made_periodic(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice((0, 1, 5, 60)))) for _ in range(80)] + [None, " \n", "a b"]
    ids = [*range(80), 95, 96, None]
    got = {r["doc_id"]: r["text"] for r in queries.made_periodic(docs_of(spark, texts, ids)).collect()}
    assert len(got) == len(ids)
    for i, t in zip(ids, texts, strict=True):
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert got[i].split() == [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        else:
            assert got[i] == t


# conversations


def brute_trie(rows, graft):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    convs = {c: [x[1] for x in sorted(t, key=lambda z: z[0])] for c, t in convs.items()}
    if graft:
        made = {}
        for c, t in convs.items():
            h = zlib.crc32(str(c).encode()) % 4
            made[c] = convs.get(c - c % 20, [])[:h] + t[h:]
        convs = made
    members = collections.defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(n)))).encode()).hexdigest())
        for n, m in members.items()
    )


def random_turns(rng, n_convs, longest):
    out = []
    for c in rng.sample(range(200), n_convs):
        for t in range(rng.randrange(1, longest)):
            out.append((c, rng.choice((t, t, None)), rng.choice(("user", "user", "", None)), rng.choice(("a b", "a b", "c", None, "é  d\n"))))
    return out


@pytest.mark.parametrize(("graft", "chunk", "hot"), [(True, 1024, 1000), (False, 3, 2), (True, 2, 1)])
def test_trie_against_brute_force(spark, monkeypatch, graft, chunk, hot):
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    monkeypatch.setattr(skew, "LEAST_HOT", hot)
    rng = random.Random(chunk)
    rows = random_turns(rng, 90, 9) + [(7, k, "user", f"t{k}") for k in range(70)] + [(None, 1, "user", "lost"), (300, None, None, None), (301, None, None, None)]
    rows += [(20 * k + 5, 0, "user", "absent base") for k in range(20, 30)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, k1 long, part string, n long")
    got = conversation_trie.conversation_trie(df, graft=graft).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == brute_trie(rows, graft)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.conversation_trie(empty, graft=True).count() == 0
    one = spark.createDataFrame([(20, 0, "user", "x " * 300_000)], "conv_id long, turn long, role string, text string")
    rows = conversation_trie.conversation_trie(one).collect()
    assert sorted((r["depth"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in rows) == [(0, 1, 1, 0), (1, 1, 1, 0)]


def test_ends_are_hashed_in_portions():
    import pyarrow as pa

    n = 3 * conversation_trie.PACKED + 5
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n + [2]), pa.array([0] * (n + 1)), pa.array([*range(n), 5])], names=["k1", "k2", "conv_id"])
    parts = list(conversation_trie._packed(iter([batch.slice(0, 100), batch.slice(100)])))
    assert sum(len(x) for x in parts) == 5
    got = [r for x in conversation_trie._hashed(iter(parts)) for r in x.to_pylist()]
    assert [(r["k1"], r["ends_sha256"]) for r in got] == [(1, hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()), (2, hashlib.sha256(b"5").hexdigest())]


# MinHash


def least_of(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("hot", [1000, 2])
def test_alternating_stars(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "LEAST_HOT", hot)
    rng = random.Random(hot)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(60)] + [(5, 5)]
    found = skew.alternating_stars(shared.Scratch(spark, "stars"), spark.createDataFrame(links, "a long, b long")).collect()
    links = [p for p in links if p[0] != p[1]]
    want = least_of(links, {x for p in links for x in p})
    assert len(found) == len(want) and {r["node"]: r["root"] for r in found} == want
    assert skew.alternating_stars(shared.Scratch(spark, "stars"), spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("block", "hot"), [(2048, 1000), (4, 2)])
def test_minhash_against_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(skew, "LEAST_HOT", hot)
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    texts = [" ".join(prose(rng.choice((2, 30, 120)))) for _ in range(40)]
    for base in (prose(150), prose(25)):
        for _ in range(30):  # near copies, some at the threshold
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 6))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    shared_ = prose(60)
    texts += [" ".join(prose(20) + shared_ + prose(20)) for _ in range(6)]
    texts += [None, "", "  \n\t", "one", "one", "É é\x0bÉ", texts[0].upper(), texts[0], " ".join(prose(30_000))]

    def shingles(t):
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    found = minhash.minhash_components(docs_of(spark, texts), 3, 85, 100, block).collect()
    assert len(found) == len(texts)
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in enumerate(sets)}
    assert {r["doc_id"]: r["component_id"] for r in found} == least_of(links, range(len(texts)))


def test_minhash_odd_rows(spark):
    texts, ids = ["a b c d e f", "a b c d e f", "a b c d e f", None, ""], [3, 3, None, 1, None]
    docs = docs_of(spark, texts, ids)
    found = minhash.minhash_components(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (-1, -1), (1, 1), (3, 3), (3, 3)]
    kept = minhash.keep_first_of_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 3, 3]
    assert minhash.minhash_components(docs_of(spark, [])).count() == 0


def test_minima_estimate_similarity():
    rng = np.random.default_rng(4)
    agree = minhash.least_agreement(85, 100)
    assert 240 < agree < 299
    for n in (8, 40, 3000):  # pairs at the threshold
        union = rng.integers(0, 1 << 63, n).astype(np.uint64)
        both = -(-85 * n // 100)
        for _ in range(40):
            rng.shuffle(union)
            a, b = np.sort(union[: both + (n - both) // 2]), np.sort(np.concatenate([union[:both], union[both + (n - both) // 2 :]]))
            m = minhash.minima([a, b])
            assert ((m[:, 0] & 255) == (m[:, 1] & 255)).sum() >= agree
            s = minhash._bands(m, minhash.ROWS, minhash.BANDS)
            assert (s[:, 0] == s[:, 1]).any()
