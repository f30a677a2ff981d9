"""Worked examples, and properties held against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.functions import canonical, hpc, run_score, windows
from helixframe.operators import combine as C
from helixframe.operators import lookup, reports, values
from helixframe.operators.counting import count_kmers
from helixframe.sources import datasets, sequences, tracks

IN1 = [("AAAA", 1), ("AAAC", 1), ("CAAT", 1), ("GGGG", 1)]
IN2 = [("AAAA", 2), ("CAAT", 2)]
IN3 = [("AAAA", 3), ("CCCC", 3), ("GGGG", 3)]


@pytest.fixture(scope="module")
def dbs(spark):
    return [spark.createDataFrame([(k, v, 1 << i) for k, v in x], "kmer string, value long, label long") for i, x in enumerate((IN1, IN2, IN3))]


def got(df):
    return {r["kmer"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize(
    ("op", "want"),
    [
        ("union-sum", {"AAAA": 6, "AAAC": 1, "CAAT": 3, "CCCC": 3, "GGGG": 4}),
        ("union", {"AAAA": 3, "AAAC": 1, "CAAT": 2, "CCCC": 1, "GGGG": 2}),
        ("union-min", {"AAAA": 1, "AAAC": 1, "CAAT": 1, "CCCC": 3, "GGGG": 1}),
        ("union-max", {"AAAA": 3, "AAAC": 1, "CAAT": 2, "CCCC": 3, "GGGG": 3}),
        ("intersect", {"AAAA": 1}),
        ("intersect-sum", {"AAAA": 6}),
        ("subtract", {"AAAC": 1}),
        ("difference", {"AAAC": 1}),
        ("symmetric-difference", {"AAAC": 1, "CCCC": 3}),
    ],
)
def test_set_operations(dbs, op, want):
    assert got(C.combine(op, *dbs)) == want


def test_thresholds_labels_and_statistics(dbs):
    u = C.combine("union-sum", *dbs)
    assert got(values.select_value(u, "at-least", distinct=0.9)) == {"AAAA": 6, "GGGG": 4}
    assert got(values.select_value(u, "at-least", word_frequency=0.2)) == {"AAAA": 6, "CAAT": 3, "CCCC": 3, "GGGG": 4}
    assert got(values.change_value(u, "divide-round", 4)) == {"AAAA": 2, "AAAC": 1, "CAAT": 1, "CCCC": 1, "GGGG": 1}
    assert got(values.change_value(u, "modulo", 3)) == {"AAAC": 1, "GGGG": 1}
    s = reports.statistics(u, 4).first()
    assert (s["unique_kmers"], s["distinct_kmers"], s["present_kmers"], s["missing_kmers"]) == (1, 5, 17, "251")
    labels = C.assigned(C.active(*dbs), C.assign_value("count"), C.assign_label("or"))
    assert {r["kmer"]: r["label"] for r in labels.collect()} == {"AAAA": 7, "AAAC": 1, "CAAT": 3, "CCCC": 4, "GGGG": 5}


def test_scalars(spark):
    r = spark.sql("SELECT 'AACCGTTTA' h, 'GGA' c, 'AAGGCTTCAG' s")
    assert tuple(r.select(hpc("h"), canonical("c"), run_score("s", "GA"), run_score("s", "TC")).first()) == ("ACGTA", "TCC", 6, 4)
    one = spark.createDataFrame([("GGAGCT",)], "bases string")
    assert got(count_kmers(one, k=3)) == {"AGC": 2, "CTC": 1, "TCC": 1}


@pytest.mark.parametrize("chunk", [70, 4096])
def test_windows_against_python(spark, chunk):
    rng = random.Random(7)
    seqs = [(i, "".join(rng.choice("ACGTN" if i % 2 else "ACGT") for _ in range(n))) for i, n in enumerate((0, 3, 9, 10, 300, 1000))]
    w = windows(spark.createDataFrame(seqs, "ident int, bases string"), 9, "ident", chunk=chunk)
    want = {(i, p, s[p : p + 9]) for i, s in seqs for p in range(len(s) - 8) if "N" not in s[p : p + 9]}
    rows = [tuple(r) for r in w.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_strands_agree(spark):
    rng = random.Random(3)
    s = "".join(rng.choice("ACGT") for _ in range(500))
    r = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = (spark.createDataFrame([(1, x)], "ident int, bases string") for x in (s, r))
    assert got(count_kmers(a, k=7)) == got(count_kmers(b, k=7))
    db = count_kmers(spark.createDataFrame([(s[:200],)], "bases string"), k=11)
    e = [lookup.existence(x, 11, db).first() for x in (a, b)]
    assert e[0]["found"] == e[1]["found"] >= 190


def test_runs_and_depth(spark):
    db = spark.createDataFrame([("AAAC", 1), ("AACA", 1)], "kmer string, value long")
    q = spark.createDataFrame([(1, "AAACAGGG")], "ident int, bases string")
    h = lookup.hits(q, 4, db)
    for span in (1, 2, lookup.SPAN):
        assert [tuple(x) for x in lookup.bed_runs(h, 4, span=span).select("begin", "end").collect()] == [(0, 5)]
    depth = {x["pos"]: x["value"] for x in lookup.wig_depth(h, 4).collect()}
    assert depth == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1}


def test_files(spark, tmp_path):
    s = [("a", "ACGTACGTAA"), ("b x", "GGGTTTCCCA")]
    sequences.write_fasta(spark.createDataFrame(s, "ident string, bases string"), str(tmp_path / "fa"))
    assert sorted(tuple(r) for r in sequences.read_fasta(spark, str(tmp_path / "fa")).collect()) == s
    db = count_kmers(sequences.read_fasta(spark, str(tmp_path / "fa")), k=5)
    datasets.write_dataset(db, str(tmp_path / "db"))
    assert got(datasets.read_dataset(spark, str(tmp_path / "db"))) == got(db)
    datasets.write_list(db, str(tmp_path / "list"), files=3)
    lines = spark.read.text(str(tmp_path / "list")).select(F.split("value", "\t").alias("w")).select(F.col("w")[0].alias("kmer"), F.col("w")[1].cast("long").alias("value"))
    assert got(lines) == got(db)
    (tmp_path / "x.fq").write_text("@r1\nACGT\n+\n!!!!\n@r2\nGGCC\n+\n@@@@\n")
    assert sorted(r["bases"] for r in sequences.read_fastq(spark, str(tmp_path / "x.fq")).collect()) == ["ACGT", "GGCC"]


def test_import_directives(spark):
    lines = [(1, "ACG", None), (2, "#5", None), (3, "ACG", None), (4, "CGT", "2"), (5, "TTT", None)]
    df = spark.createDataFrame([(*x, None) for x in lines], "line long, word1 string, word2 string, word3 string")
    assert got(datasets.import_list(df)) == {"ACG": 8, "AAA": 5}


def test_folds_against_python(spark):
    rng = random.Random(11)
    kmers = ["".join(rng.choice("ACGT") for _ in range(4)) for _ in range(40)]
    ins = [{k: rng.randint(1, 50) for k in rng.sample(kmers, 25)} for _ in range(3)]
    dfs = [spark.createDataFrame(list(x.items()), "kmer string, value long") for x in ins]
    a = C.active(*dfs).cache()
    lists = {k: [x[k] for x in ins if k in x] for k in set().union(*ins)}

    def div(v):
        s = v[0]
        for x in v[1:]:
            s //= x
        return s

    assert got(C.assigned(a, C.assign_value("div"))) == {k: div(v) for k, v in lists.items() if div(v)}
    assert got(C.assigned(a, C.assign_value("sub"))) == {k: max(0, v[0] - sum(v[1:])) for k, v in lists.items() if v[0] > sum(v[1:])}
    assert got(C.assigned(a, C.assign_value("count"), where=C.in_all_of(1, 3))) == {k: len(v) for k, v in lists.items() if k in ins[0] and k in ins[2]}
    n = Counter(len(v) for v in lists.values())
    assert C.assigned(a, C.assign_value("first"), where=C.in_inputs(2)).count() == n[2]


def test_stream(spark, tmp_path):
    from helixframe.streaming import stream_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ACGTACGT\nGGGG\n")
    s = spark.readStream.schema("bases string").text(str(tmp_path / "in"))
    q = stream_counts(s, 4).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert got(spark.table("counts")) == {"ACGT": 2, "CGTA": 2, "GTAC": 1, "CCCC": 1}  # TACG is the other strand of CGTA


def test_runs_and_depths_of_spans_against_python(spark):
    rng = random.Random(5)
    at = {i: sorted(rng.sample(range(300), n)) for i, n in enumerate((1, 40, 200, 290))}
    found = spark.createDataFrame([(i, p, 0, 1) for i, ps in at.items() for p in ps] * 2, "ident int, pos long, db int, value long")
    runs, depth = set(), {}
    for i, ps in at.items():
        for p in ps:
            if p - 1 not in ps:
                q = p
                while q + 1 in ps:
                    q += 1
                runs.add((i, p, q + 9))
        depth |= {(i, x + 1): n for x in range(310) if (n := sum(p <= x < p + 9 for p in ps))}
    for span in (7, 64, 1 << 20):
        assert sorted(tuple(r) for r in lookup.bed_runs(found, 9, span=span).select("ident", "begin", "end").collect()) == sorted(runs)
        rows = lookup.wig_depth(found, 9, span=span).collect()
        assert {(r["ident"], r["pos"]): r["value"] for r in rows} == depth and len(rows) == len(depth)


def test_labels_of_set_operations(dbs):
    both = lambda op: {r["kmer"]: (r["value"], r["label"]) for r in C.combine(op, *dbs).collect()}
    assert both("union") == {"AAAA": (3, 7), "AAAC": (1, 1), "CAAT": (2, 3), "CCCC": (1, 4), "GGGG": (2, 5)}
    assert both("union-max")["AAAA"] == (3, 4) and both("union-min")["CAAT"] == (1, 1) and both("union-sum")["GGGG"] == (4, 5)
    assert both("intersect") == {"AAAA": (1, 0)} and both("intersect-max") == {"AAAA": (3, 4)}
    assert both("subtract") == {"AAAC": (1, 1)} and both("difference") == {"AAAC": (1, 1)} and both("symmetric-difference")["CCCC"] == (3, 4)
    a = C.active(*dbs)
    picked = {r["kmer"]: (r["value"], r["label"]) for r in C.assigned(a, C.selected("value", "max"), C.selected("label", "min")).collect()}
    assert picked["AAAA"] == (3, 1) and picked["GGGG"] == (3, 1)
    assert {r["kmer"] for r in C.combine("union", *dbs).where(C.label_test("all", 5)).collect()} == {"AAAA", "GGGG"}
    assert {r["kmer"] for r in C.combine("union", *dbs).where(C.label_test("only", 3)).collect()} == {"AAAC", "CAAT"}


def test_arguments():
    lookup.check_report("include", 2, 1)
    lookup.check_report("bed", 1, 2, 2)
    for wrong in (("bed", 2, 1, 0), ("wig-depth", 1, 2, 0), ("existence", 1, 2, 2), ("bed", 1, 2, 1), ("nothing", 1, 1, 0), ("include", 1, 0, 0)):
        with pytest.raises(ValueError):
            lookup.check_report(*wrong)
    for wrong in (1.5, -1, True, "3"):
        with pytest.raises(ValueError):
            values.arithmetic("increase", wrong)
    with pytest.raises(ValueError):
        values.select_threshold("at-least", None, None, distinct=0.5)
    with pytest.raises(ValueError):
        values.select_threshold("at-least", None, value="count", distinct=0.5)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_whatever_its_qualities(spark, tmp_path, small_splits, end):
    rng = random.Random(3)
    reads = [(f"r{i} x", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@@I+>") for _ in range(n))) for i, n in enumerate(rng.choices(range(1, 30), k=60))]
    (tmp_path / "x.fq").write_bytes("".join(f"@{i}{end}{b}{end}+{end}{q}{end}" for i, b, q in reads).encode())
    df = sequences.read_fastq(spark, str(tmp_path / "x.fq"))
    assert df.rdd.getNumPartitions() > 8
    assert sorted(tuple(r) for r in df.collect()) == sorted(reads)


def test_formats(spark, tmp_path):
    import lzma

    fasta = ">a\r\nACGT\r\nAC\r\n>b c\r\nggg\r\n"
    (tmp_path / "x.fa").write_bytes(fasta.encode())
    (tmp_path / "x.fa.xz").write_bytes(lzma.compress(fasta.encode()))
    (tmp_path / "x.fq.xz").write_bytes(lzma.compress(b"@r\nACGT\n+\n@@@@\n"))
    (tmp_path / "x.txt").write_text("ACGT\nggcc\n")
    for name in ("x.fa", "x.fa.xz"):
        assert sorted(tuple(r) for r in sequences.read_sequences(spark, str(tmp_path / name)).collect()) == [("a", "ACGTAC"), ("b c", "GGG")]
    assert [tuple(r) for r in sequences.read_fastq(spark, str(tmp_path / "x.fq.xz")).collect()] == [("r", "ACGT", "@@@@")]
    assert sorted(r["bases"] for r in sequences.read_sequences(spark, str(tmp_path / "x.txt")).collect()) == ["ACGT", "GGCC"]


def test_lists_of_files(spark, tmp_path, small_splits):
    rng = random.Random(8)
    value, label, want, out = 1, 0, Counter(), []
    for _ in range(400):
        x = rng.random()
        if x < 0.05:
            value = rng.randrange(1, 50)
            out.append(rng.choice((f"#{value}", f"value={value}")))
        elif x < 0.1:
            label = rng.randrange(64)
            out.append(f"label={label}")
        else:
            kmer, own = "".join(rng.choice("ACGT") for _ in range(3)), rng.randrange(3)
            out.append([kmer, f"{kmer}\t7", f"{kmer} 7  9"][own])
            want[kmer, (value, 7, 7)[own], (label, label, 9)[own]] += 1
    (tmp_path / "list").write_text("\n".join(out) + "\n\n")
    lines = datasets.read_list(spark, str(tmp_path / "list"))
    assert [r["word1"] for r in lines.orderBy("line").collect()] == [x.split()[0] for x in out]
    found = datasets.import_list(lines, strand="forward", multiset=True).collect()
    assert Counter((r["kmer"], r["value"], r["label"]) for r in found) == want


def test_segments_and_numbers(spark):
    rng = random.Random(4)
    seqs = [(i, "A" * rng.randrange(1, 30)) for i in range(500)]
    rng.shuffle(seqs)
    df = spark.createDataFrame(seqs, "o int, bases string").repartition(5)
    total, at, want = sum(len(b) for _, b in seqs), 0, [set(), set(), set()]
    for i, b in sorted(seqs):
        want[min(2, at // (total // 3))].add(i)
        at += len(b)
    assert [{r["o"] for r in sequences.segment(df, "o", n, 3).collect()} for n in (1, 2, 3)] == want
    assert {r["o"]: r["ident"] for r in sequences.numbered(df, "o").collect()} == {i: i for i, _ in seqs}


def test_written_reports(spark, tmp_path):
    db = spark.createDataFrame([("AAAC", 1), ("AACA", 1)], "kmer string, value long")
    other = spark.createDataFrame([("AACA", 5), ("AAAA", 1), ("CCCC", 1)], "kmer string, value long")
    q = spark.createDataFrame([("s1", "AAACAGGG", None), ("s2", "CCAAC", "IIIII"), ("s3", "AAAAAACA", "@@@@@@@@")], "ident string, bases string, quals string")
    read = lambda name: [x for f in sorted((tmp_path / name).glob("part-*")) for x in f.read_text().splitlines()]
    h = lookup.hits(q, 4, db, other)
    tracks.write_bed(lookup.bed(h, 4, ["A", "B"]), str(tmp_path / "bed"), files=2)
    assert read("bed") == ["s1\t0\t4\tA", "s1\t1\t5\tA", "s1\t1\t5\tB", "s3\t0\t4\tB", "s3\t1\t5\tB", "s3\t2\t6\tB", "s3\t3\t7\tA", "s3\t4\t8\tA", "s3\t4\t8\tB"]
    tracks.write_wig(lookup.wig_depth(lookup.hits(q, 4, db), 4), str(tmp_path / "wig"), files=1)
    assert read("wig")[:6] == ["variableStep chrom=s1", "1\t1", "2\t2", "3\t2", "4\t2", "5\t1"] and read("wig")[6] == "variableStep chrom=s3"
    tracks.write_existence(lookup.existence(q, 4, db, other), str(tmp_path / "ex"), files=2)
    assert read("ex") == ["s1\t5\t2\t2\t3\t1", "s2\t2\t2\t0\t3\t0", "s3\t5\t2\t2\t3\t4"]
    sequences.write_found(lookup.include(q, 4, db), str(tmp_path / "in"))
    assert sorted(read("in")) == sorted([">s1 nKmers=2", "AAACAGGG", "@s3 nKmers=2", "AAAAAACA", "+", "@@@@@@@@"])
    assert sorted(tuple(r) for r in lookup.hit_table(q.where("ident = 's1'"), q.where("ident = 's3'"), 4).collect()) == [("s3", 3, "s1", 0), ("s3", 4, "s1", 1)]


def test_slices_of_datasets(spark, tmp_path):
    rng = random.Random(6)
    db = count_kmers(spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(400)),)], "bases string"), k=7)
    datasets.write_dataset(db, str(tmp_path / "db"))
    everything = got(db)
    for x in ("AAC", "CTG", "ACG"):
        assert got(datasets.read_dataset(spark, str(tmp_path / "db"), x)) == {k: v for k, v in everything.items() if k.startswith(x)}
    (tmp_path / "h").write_text("1\t5\n2\t3\n")
    assert [tuple(r) for r in datasets.read_histogram(spark, str(tmp_path / "h")).collect()] == [(1, 5), (2, 3)]


def test_noise_and_peaks(spark):
    counts = [90, 40, 12, 6, 9, 20, 45, 60, 44, 21, 9, 3, 4, 9, 12, 9, 3]
    h = spark.createDataFrame([(i + 1, n) for i, n in enumerate(counts)], "value long, occurrences long")
    r = reports.ploidy(h).first()
    smooth = [sum(counts[max(0, i - 2) : i + 3]) / len(counts[max(0, i - 2) : i + 3]) for i in range(len(counts))]
    noise = next(i + 1 for i in range(1, len(counts) - 1) if smooth[i] <= smooth[i - 1] and smooth[i] < smooth[i + 1])
    peak = max(range(noise, len(counts)), key=lambda i: smooth[i]) + 1
    assert tuple(r) == (noise, peak, 2 * peak, 3 * peak, 4 * peak)
