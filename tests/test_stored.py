"""Packed k-mers, record ordinals, stored datasets, and streams into them."""

import lzma
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.functions import pack, packed, packed_windows, sieve, unpacked
from helixframe.functions import codes
from helixframe.operators import combine as C
from helixframe.operators import lookup, paths, superkmers
from helixframe.operators.counting import count_kmers
from helixframe.sources import sequences, stored, tracks
from helixframe.streaming import stream_into

rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
key = lambda s: s.translate(str.maketrans("ACTG", "0123"))


def got(df):
    return {r["kmer"]: r["value"] for r in df.collect()}


def random_seqs(n, rng, letters="ACGT"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 9, 31, 32, 33, 42, 64])
def test_packed_keys(spark, k):
    rng = random.Random(k)
    seqs = [*random_seqs(12, rng), *random_seqs(12, rng, "ACGTNN"), "", "A" * 150, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "ident int, bases string")
    want = [(i, p, min(s[p : p + k], rc(s[p : p + k]), key=key)) for i, s in enumerate(seqs) if s for p in range(len(s) - k + 1) if "N" not in s[p : p + k]]
    rows = unpacked(packed_windows(df, k, "ident").withColumn("value", F.lit(1)), k)
    assert sorted((r["ident"], r["pos"], r["kmer"]) for r in rows.select("ident", "pos", "kmer").collect()) == sorted(want)
    counts = count_kmers(df, k=k)
    assert got(counts) == Counter(x for _, _, x in want)
    # from strings and back, in the order of the bases
    again = packed(counts, k)
    assert got(unpacked(again, k)) == got(counts)
    names = [c for c in again.columns if c.startswith("code")]
    ordered = [r["kmer"] for r in counts.select("kmer", *pack("kmer", k)).orderBy(*names).collect()]
    assert ordered == sorted(ordered, key=key)
    ends = count_kmers(df, k=k, suffix="C" if k == 1 else "ac")
    assert got(ends) == {x: n for x, n in got(counts).items() if x.endswith("C" if k == 1 else "AC")}


def test_pieces_of_a_long_sequence(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(codes, "PIECE", 50)
    rng = random.Random(2)
    seqs = random_seqs(20, rng, "ACGTN")
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(seqs)], names=["i", "bases"]).slice(3)
    rows = [r for b in codes._windows(9, "both", ["i"])([batch]) for r in b.to_pylist()]
    number = lambda s: int(key(s), 4)
    want = []
    for i, s in enumerate(seqs[3:], 3):
        for p in range(len(s) - 8):
            w = s[p : p + 9]
            if "N" not in w:
                want += [(i, p, number(x)) for x in {w, rc(w)}]
    assert sorted((r["i"], r["pos"], r["code"]) for r in rows) == sorted(want)


def split_small(spark, f):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        return f()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ordinals_across_splits(spark, tmp_path):
    rng = random.Random(4)
    bases = [s or "A" for s in random_seqs(60, rng)]
    names = [rng.choice(("a", "b c", "")) for _ in bases]
    half = 25
    for part, lo, hi in (("1", 0, half), ("2", half, len(bases))):
        (tmp_path / "fa").mkdir(exist_ok=True)
        (tmp_path / "fq").mkdir(exist_ok=True)
        (tmp_path / "raw").mkdir(exist_ok=True)
        (tmp_path / "xz").mkdir(exist_ok=True)
        fasta = "".join(f">{n}\n{b}\n" for n, b in zip(names[lo:hi], bases[lo:hi], strict=True))
        (tmp_path / "fa" / f"{part}.fa").write_text(fasta)
        (tmp_path / "fq" / f"{part}.fq").write_text("".join(f"@{n}\n{b}\n+\n{'@' * len(b)}\n" for n, b in zip(names[lo:hi], bases[lo:hi], strict=True)))
        (tmp_path / "raw" / f"{part}.txt").write_text("\n\n".join(bases[lo:hi]) + "\n")
        (tmp_path / "xz" / f"{part}.fa.xz").write_bytes(lzma.compress(fasta[:500].encode()) + lzma.compress(fasta[500:].encode()))

    for folder, read, named in (("fa", sequences.read_fasta, True), ("fq", sequences.read_fastq, True), ("raw", sequences.read_raw, False), ("xz", sequences.read_sequences, True)):

        def check(folder=folder, read=read, named=named):
            df = read(spark, str(tmp_path / folder), ordinals=True)
            rows = sorted((r["seq_idx"], r["ident"], r["bases"]) for r in df.collect())
            assert rows == [(i, n if named else None, b) for i, (n, b) in enumerate(zip(names, bases, strict=True))]
            assert folder == "xz" or df.rdd.getNumPartitions() > 4

        split_small(spark, check)


def test_records_with_equal_and_missing_names(spark, tmp_path):
    db = spark.createDataFrame([("AAAC", 1), ("AACA", 2), ("ACAA", 1), ("CCCC", 1)], "kmer string, value long")
    q = spark.createDataFrame([(0, "a", "AAACAA"), (1, "a", "GGGGGTGT"), (2, None, "AAAC"), (3, None, "TATATA"), (4, "b", "A")], "seq_idx long, ident string, bases string")
    inc = lookup.report("include", [q], [db], 4).collect()
    assert sorted((r["seq_idx"], r["n_kmers"]) for r in inc) == [(0, 3), (1, 2), (2, 1)]
    assert sorted(r["seq_idx"] for r in lookup.report("exclude", [q], [db], 4).collect()) == [3, 4]
    ex = lookup.report("existence", [q], [db, db.where("value = 2")], 4).collect()
    assert sorted((r["seq_idx"], r["n_kmers"], r["db"], r["db_kmers"], r["found"]) for r in ex) == [(0, 3, 0, 4, 3), (0, 3, 1, 1, 1), (1, 5, 0, 4, 2), (1, 5, 1, 1, 0), (2, 1, 0, 4, 1), (2, 1, 1, 1, 0), (3, 3, 0, 4, 0), (3, 3, 1, 1, 0), (4, 0, 0, 4, 0), (4, 0, 1, 1, 0)]
    tracks.write_bed(lookup.report("bed", [q], [db], 4), str(tmp_path / "bed"), files=1)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "bed")).collect()] == ["a\t0\t4", "a\t1\t5", "a\t2\t6", "a\t0\t4", "a\t1\t5", "\t0\t4"]
    tracks.write_wig(lookup.report("wig-depth", [q], [db], 4), str(tmp_path / "wig"), files=1, sequences=q)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "wig")).collect()]
    assert [x for x in lines if x.startswith("v")] == ["variableStep chrom=a", "variableStep chrom=a", "variableStep chrom=", "variableStep chrom=", "variableStep chrom=b"]
    tracks.write_existence(lookup.report("existence", [q], [db], 4), str(tmp_path / "ex"), files=1)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "ex")).collect()] == ["a\t3\t4\t3", "a\t5\t4\t2", "\t1\t4\t1", "\t3\t4\t0", "b\t0\t4\t0"]
    sequences.write_found(lookup.report("include", [q], [db], 4), str(tmp_path / "in"), files=1)
    assert "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "in")).collect()).split("\n")[4] == "> nKmers=1"
    mates = spark.createDataFrame([(1, "m", "AACA"), (5, None, "CCCC")], "seq_idx long, ident string, bases string")
    pairs = lookup.report("include", [q, mates], [db], 4).collect()
    assert sorted((r["seq_idx"], r["n_kmers"], r["mate_bases"]) for r in pairs) == [(0, 3, None), (1, 3, "AACA"), (2, 1, None), (5, 1, "CCCC")]
    with pytest.raises(ValueError):
        lookup.report("wig-depth", [q], [db, db], 4)


def test_stored_datasets_merge_without_a_shuffle(spark, tmp_path):
    rng = random.Random(5)
    ins = [{"".join(rng.choice("ACGT") for _ in range(4)): rng.randint(1, 9) for _ in range(90)} for _ in range(3)]
    paths = [str(tmp_path / f"db{i}") for i in range(3)]
    dfs = [spark.createDataFrame(list(x.items()), "kmer string, value long") for x in ins]
    for df, p in zip(dfs, paths, strict=True):
        assert stored.store(df, p, 4, buckets=8).n == df.count()
    for op in ("union-sum", "union-min", "intersect-sum", "intersect", "subtract", "difference", "symmetric-difference", "union"):
        merged = C.combine_stored(spark, op, *paths)
        assert "Exchange" not in merged._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert got(unpacked(merged, 4)) == got(C.combine(op, *dfs))
        assert merged.count() == C.combine(op, *dfs).count()
    lists = C.assigned(C.active_stored(spark, *paths), C.assign_value("max"))
    assert got(unpacked(lists, 4)) == got(C.combine("union-max", *dfs))
    assert got(unpacked(C.combine_stored(spark, "union-sum", paths[0], paths[0]), 4)) == {x: 2 * n for x, n in ins[0].items()}
    part = unpacked(stored.read_stored(spark, paths[0], begins="CA"), 4)
    assert got(part) == {x: n for x, n in ins[0].items() if x.startswith("CA")}
    other = str(tmp_path / "other")
    stored.store(dfs[0], other, 4, buckets=3)
    assert got(unpacked(C.combine_stored(spark, "union-sum", other, paths[1]), 4)) == got(C.combine("union-sum", *dfs[:2]))


def test_sidecar(spark, tmp_path):
    db = spark.createDataFrame([("AAAC", 3, 5), ("CCCC", 3, 1), ("ACAC", 7, 0)], "kmer string, value long, label long")
    a, b, c = (str(tmp_path / x) for x in "abc")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("write"))
    spark.sparkContext.setJobGroup("write", "write")
    stored.store(db, a, 4, buckets=4, histogram=True, label_bits=8)
    assert jobs() <= 2  # the shuffle's stage and the write, were it planned adaptively
    spark.sparkContext._jsc.clearJobGroup()
    meta = stored.meta_of(spark, a)
    assert (meta.k, meta.n, meta.total, meta.label_bits, meta.strand) == (4, 3, 13, 8, "canonical")
    assert {r["value"]: r["occurrences"] for r in stored.stored_histogram(spark, a).collect()} == {3: 2, 7: 1}
    assert {r["code"]: r["label"] for r in stored.read_stored(spark, a).collect()} == {r["code"]: r["label"] for r in packed(db, 4).collect()}
    stored.store(spark.createDataFrame([("AAACC", 1)], "kmer string, value long"), b, 5, buckets=4)
    stored.store(db, c, 4, strand="forward", buckets=4)
    for other in (b, c, str(tmp_path / "none")):
        with pytest.raises(ValueError):
            C.combine_stored(spark, "union", a, other)
    stored.store(db.where("value = 7"), a, 4, buckets=4)  # replaces
    assert stored.read_stored(spark, a).count() == 1 and stored.meta_of(spark, a).n == 1
    (tmp_path / "x.fa").write_text(">a\nACGT\n")
    (tmp_path / "x.list").write_text("\n#5\nACG\n")
    (tmp_path / "y.list").write_text("ACG\t5\n")
    assert [stored.kind_of(spark, str(tmp_path / x)) for x in ("a", "x.fa", "x.list", "y.list")] == ["dataset", "sequences", "list", "list"]
    assert [r["value"] for r in stored.open_input(spark, a, 4)[1].collect()] == [7]
    assert got(stored.open_input(spark, str(tmp_path / "x.list"))[1]) == {"ACG": 5}
    assert [(r["seq_idx"], r["bases"]) for r in stored.open_input(spark, str(tmp_path / "x.fa"))[1].collect()] == [(0, "ACGT")]
    for k, strand in ((5, "canonical"), (4, "forward")):
        with pytest.raises(ValueError):
            stored.open_input(spark, a, k, strand)
    empty = str(tmp_path / "empty")
    stored.store(db.where("false"), empty, 4, buckets=4, histogram=True)
    assert stored.read_stored(spark, empty).count() == 0 and stored.stored_histogram(spark, empty).count() == 0


def test_sieve_loses_no_hit(spark):
    rng = random.Random(8)
    seqs = [(i, s) for i, s in enumerate(random_seqs(40, rng))]
    df = spark.createDataFrame(seqs, "ident int, bases string")
    for k in (11, 40):
        db = count_kmers(df.where("ident < 3"), k=k)
        s = sieve([db], k)
        few = packed_windows(df, k, "ident", sieve=s).count()
        found = lookup.hits(df, k, db, sieve=s)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lookup.hits(df, k, db).collect()))
        assert found.count() <= few < 0.2 * packed_windows(df, k, "ident").count()


def test_stream_into_a_dataset(spark, tmp_path):
    rng = random.Random(9)
    seqs = [s for s in random_seqs(30, rng) if s]
    source, path, check = tmp_path / "in", str(tmp_path / "db"), str(tmp_path / "check")
    source.mkdir()

    def run():
        lines = spark.readStream.text(str(source)).withColumnRenamed("value", "bases")
        stream_into(lines, path, 7, check, buckets=4).trigger(availableNow=True).start().awaitTermination()

    for i, lo in enumerate(range(0, len(seqs), 10)):
        (source / f"{i}.txt").write_text("\n".join(seqs[lo : lo + 10]))
        run()
    want = got(count_kmers(spark.createDataFrame([(s,) for s in seqs], "bases string"), k=7))
    assert got(unpacked(stored.read_stored(spark, path), 7)) == want
    # the last batch is repeated, as after a failure between the merge and the commit
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert got(unpacked(stored.read_stored(spark, path), 7)) == want


def test_label_selectors_by_truth_table(spark):
    """Each selector against its meaning, bit by bit."""
    labels = spark.createDataFrame([(x,) for x in range(64)], "label long")

    def want(functions, tests, x):
        n = len(functions)
        bits = [x >> (n - 1 - i) & 1 for i in range(n)]
        out = [{"0": 0, "1": 1, "+": b, "-": 1 - b}[f] for f, b in zip(functions, bits, strict=True)]
        of = lambda c: [b for b, t in zip(out, tests, strict=True) if t == c]
        return all(of("T")) and not any(of("F")) and (any(of("t")) or not of("t")) and (not all(of("f")) or not of("f"))

    rng = random.Random(1)
    for _ in range(25):
        n = rng.randrange(1, 7)
        f, t = "".join(rng.choice("01+-") for _ in range(n)), "".join(rng.choice("TtFfx") for _ in range(n))
        got_ = {r["label"] for r in labels.where(C.label_selector(f"{f}:{t}")).collect()}
        assert got_ == {x for x in range(64) if want(f, t, x)}, (f, t)
    two = lambda spec: {r["label"] for r in labels.where("label < 4").where(C.label_selector(spec)).collect()}
    assert [two(x) for x in ("00:all", "11:all", "-+:all", "1+:all")] == [set(), {0, 1, 2, 3}, {1}, {1, 3}]
    assert [two(x) for x in ("00:any", "11:any", "-+:any", "0+:any")] == [set(), {0, 1, 2, 3}, {0, 1, 3}, {1, 3}]
    assert [two(x) for x in ("00:none", "11:none", "-+:none", "0+:none")] == [{0, 1, 2, 3}, set(), {2}, {0, 2}]
    assert two("10") == {2} and two(".1") == {1, 3} and two(":Tx") == {2, 3}
    top = spark.createDataFrame([(-(1 << 63),), (1,)], "label long")
    assert [r["label"] for r in top.where(C.label_selector("+" + "0" * 63 + ":any")).collect()] == [-(1 << 63)]
    for spec in ("+-:T", "ab", ":all", "+" * 65):
        with pytest.raises(ValueError):
            C.label_selector(spec)


@pytest.mark.parametrize(("k", "m"), [(9, 4), (21, 9), (31, 15), (42, 9), (5, 5)])
def test_super_kmers_count_as_windows_do(spark, k, m):
    rng = random.Random(k)
    seqs = [*random_seqs(30, rng), *random_seqs(10, rng, "ACGTN"), *random_seqs(10, rng, "AC"), "A" * 3000, "ACACAC" * 300, "", None, "ACG"]
    df = spark.createDataFrame([(s,) for s in seqs], "bases string").repartition(3)
    assert got(superkmers.count_superkmers(df, k, m)) == got(count_kmers(df, k=k))


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    df = spark.createDataFrame([("A" * 50_000 + "CGT" * 20_000,), ("T" * 90_000,)] * 3, "bases string")
    want = got(count_kmers(df, k=15))
    assert got(superkmers.count_superkmers(df, 15, 5, buckets=2)) == want and want["A" * 15] > 400_000


def test_unique_paths(spark):
    rng = random.Random(12)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (300, 120, 6)]
    ring = "".join(rng.choice("ACGT") for _ in range(40))
    seqs += [seqs[0][:90] + seqs[1][50:], ring + ring[:6], "AAAAAAAAAA", "ACACACACACAC", "ACGTACGTACGT"]
    k = 7
    df = spark.createDataFrame([(s,) for s in seqs], "bases string")
    db = {r["kmer"] for r in count_kmers(df, k=k).collect()}
    out = [tuple(r) for r in paths.unique_paths(count_kmers(df, k=k, keys=True), k).select("path", "pos", "kmer").collect()]
    canon = lambda s: min(s, rc(s), key=key)
    assert sorted(canon(x) for _, _, x in out) == sorted(db)  # each k-mer once
    by = {}
    for p, i, x in out:
        by.setdefault(p, {})[i] = x
    ends = {}
    for x in db:  # ends at each junction, by side
        for e, b in ((0, x[:-1]), (1, x[1:])):
            ends.setdefault(canon(b), []).append((x, e, (b == canon(b)) == (e == 1)))
    mate = {}
    for j, some in ends.items():
        a, b = [s for s in some if s[2]], [s for s in some if not s[2]]
        if j != rc(j) and len(a) == len(b) == 1 and a[0][0] != b[0][0]:
            mate[a[0][:2]], mate[b[0][:2]] = b[0][:2], a[0][:2]
    rings = 0
    for p, x in by.items():
        assert sorted(x) == list(range(len(x))) and canon(x[0]) == p
        for i in range(1, len(x)):
            assert x[i - 1][1:] == x[i][:-1]
            assert mate[(canon(x[i - 1]), int(x[i - 1] == canon(x[i - 1])))] == (canon(x[i]), int(x[i] != canon(x[i])))
        first, last = (canon(x[0]), int(x[0] != canon(x[0]))), (canon(x[len(x) - 1]), int(x[len(x) - 1] == canon(x[len(x) - 1])))
        if first in mate or last in mate:  # a ring
            rings += 1
            assert mate[first] == last and p == min((canon(y) for y in x.values()), key=key)
        else:
            assert key(p) <= key(canon(x[len(x) - 1]))
    assert rings >= 1 and max(map(len, by.values())) > 10


@pytest.mark.parametrize(("k", "strand"), [(12, "canonical"), (21, "forward"), (42, "reverse"), (64, "canonical")])
def test_long_kmers_travel_as_super_kmers(spark, k, strand):
    """The k-mers themselves, some 20 bytes each, aren't shuffled."""
    rng = random.Random(k)
    seqs = [*random_seqs(30, rng), *random_seqs(10, rng, "ACGTN"), "A" * 3000, "ACACAC" * 300, "", None, "ACG"]
    seqs = [*seqs, *seqs[:9], *[rc(s) for s in seqs[:9]]]
    want = Counter()
    for s in seqs:
        for f in (s[p : p + k] for p in range(len(s or "") - k + 1)):
            if "N" not in f:
                want[{"forward": f, "reverse": rc(f), "canonical": min(f, rc(f), key=key)}[strand]] += 1
    db = count_kmers(spark.createDataFrame([(s,) for s in seqs], "bases string").repartition(3), k=k, strand=strand)
    plan = db._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(code" not in plan
    assert got(db) == want
