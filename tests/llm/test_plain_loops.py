"""Networks and updates against plain loops, the mix as it is written, and empty, long and oddly named inputs."""

import math
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from helixframe.llm import archives, decontamination, language_id, mixing, quality_classifier


def small_network():
    rng = np.random.default_rng(5)
    net = language_id.Network(["a", "b", "c"], seed=7)
    net.bias[:] = rng.normal(0, 0.3, net.bias.shape)
    net.out[:] = rng.normal(0, 0.3, 3)
    return net


def loops(net, window):
    """Log-probabilities of one window, and each filter's greatest response with its place."""
    wide = max(language_id.WIDTHS)
    best = []
    for f in range(net.conv.shape[1]):
        width = language_id.WIDTHS[f // language_id.FILTERS]
        top = None
        for p in range(len(window) - wide + 1):
            z = sum(float(net.embed[window[p + i]][e]) * float(net.conv[i * language_id.EMBED + e][f]) for i in range(width) for e in range(language_id.EMBED))
            if top is None or z > top[0]:
                top = z, p
        best.append(top)
    h = [max(0.0, z + float(net.bias[f])) for f, (z, _) in enumerate(best)]
    y = [sum(h[f] * float(net.dense[f][c]) for f in range(len(h))) + float(net.out[c]) for c in range(3)]
    total = math.log(sum(math.exp(v) for v in y))
    return [v - total for v in y], best


def test_forward_pass_against_loops():
    net, rng = small_network(), np.random.default_rng(1)
    x = rng.integers(1, 256, (3, 20))
    got = net.log_probabilities(x)
    for row, w in zip(got, x, strict=True):
        assert np.allclose(row, loops(net, w.tolist())[0], atol=1e-4)


def test_gradient_against_differences():
    """The first Adam step goes against the sign of the loss's slope, for every parameter that has one."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(1, 256, (4, 12)), np.array([0, 2, 1, 0])
    loss = lambda net: -np.mean([loops(net, w.tolist())[0][c] for w, c in zip(x, y, strict=True)])
    before, net = small_network(), small_network()
    net.train(x, y, epochs=1, size=4, rate=1e-3)
    for name in ("conv", "bias", "dense", "out", "embed"):
        old, new = getattr(before, name), getattr(net, name)
        moved = np.argwhere(np.abs(new - old) > 5e-4)
        for at in moved[rng.choice(len(moved), min(6, len(moved)), replace=False)]:
            at = tuple(at)
            shifted = small_network()
            kept = getattr(shifted, name)[at]
            slope = []
            for step in (2e-3, -2e-3):
                getattr(shifted, name)[at] = kept + step
                slope.append(loss(shifted))
            slope = (slope[0] - slope[1]) / 4e-3
            assert abs(slope) < 2e-3 or np.sign(slope) == -np.sign(new[at] - old[at]), (name, at)
    # a narrower filter's weights beyond its width stay nothing
    assert not (net.conv * (1 - net.mask)).any()


def test_ftrl_against_loops():
    rng = random.Random(3)
    examples = []
    for _ in range(60):
        places = sorted(rng.sample(range(40), rng.randrange(1, 8)))
        examples.append((np.array(places, np.int32), np.array([rng.randrange(1, 4) for _ in places], np.int32), rng.randrange(2)))
    model = quality_classifier.train_ftrl(examples)
    a, b, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2
    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((b + math.sqrt(n.get(i, 0.0))) / a + l2)

    for _ in range(quality_classifier.EPOCHS):
        for places, counts, label in examples:
            root = math.sqrt(counts.sum())
            x = {int(p): int(c) / root for p, c in zip(places, counts, strict=True)} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose([model.weights[i] for i in range(40)], [weight(i) for i in range(40)], atol=1e-5)
    assert abs(model.bias - weight("bias")) < 1e-9 and not model.weights[40:].any()


def test_scores_against_loops():
    rng = np.random.default_rng(4)
    model = quality_classifier.Model(rng.normal(0, 1, 1 << quality_classifier.BITS).astype(np.float32), 0.25)
    texts = ["one two two three", "", None, "word", " a  b\nc " * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    places = dict(quality_classifier._places(batch))
    for r, s in enumerate(model.scores(batch)):
        x = places.get(r, np.zeros(0, np.int64))
        n = len((texts[r] or "").split())
        assert len(x) == max(0, 2 * n - 1)  # words and pairs
        want = 0.25 + (sum(float(model.weights[i]) for i in x) / math.sqrt(len(x)) if len(x) else 0)
        assert abs(s - 1 / (1 + math.exp(-want))) < 1e-5


def test_mix_of_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i if i % 9 else None, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(12))), f"s{i % 4}") for i in range(120)]
    rows += rows[:15] + [(7, "another text of that id", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix_sources(docs, shards=4).groupBy("source").sum("taken").collect()
    mixing.write_mix(docs, str(tmp_path / "mix"), shards=4)
    out = spark.read.parquet(str(tmp_path / "mix"))
    words = {}
    for r in out.collect():
        assert len((r["text"] or "").split()) == r["words"]
        words[r["source"]] = words.get(r["source"], 0) + r["words"]
    assert words == {r["source"]: r["sum(taken)"] for r in taken if r["sum(taken)"]}
    assert out.where("doc_id is null").count() > 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    model = quality_classifier.fit_quality(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_classifier.score_quality(none, model).count() == 0 and quality_classifier.keep_quality(none, model).count() == 0
    assert language_id.predict_languages(none, language_id.fit_languages(none)).count() == 0
    index = decontamination.build_index(spark.createDataFrame([(1, "a question of some words? an answer.")], "item_id long, text string"))
    assert decontamination.benchmark_matches(none, index).count() == 0
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_very_long_texts(spark):
    long = "the quick brown fox jumps over it and 7 dogs\n" * 120_000  # 5 MB
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, "ein kurzer Text und noch ein Wort", "de", "s", 1)], DOCS)
    net = small_network()
    assert {r["lang_pred"] for r in language_id.predict_languages(docs, net).collect()} <= set(net.languages)
    model = quality_classifier.fit_quality(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    scores = {r["doc_id"]: r["quality_score"] for r in quality_classifier.score_quality(docs, model).collect()}
    assert scores[1] < 0.5 < scores[2]
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "x")], "page_id long, url string, html string")
    found = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archives.archive_pages(pages).collect()}
    assert found == {1: (len(long), "response", None), 2: (len(long), "revisit", 1), 3: (1, "response", None)}


def test_clashing_names_of_archives(spark):
    names = ["payload_bytes", "payload_digest", "record_type", "refers_to", "digest", "record", "n", "kind", "path"]
    rows = [(k, "http://x/", "page" if k < 3 else None, *["x"] * len(names)) for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"{x} string" for x in names))
    found = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archives.archive_pages(pages).collect()}
    assert found == {0: (4, "response", None), 1: (4, "revisit", 0), 2: (4, "revisit", 0), 3: (0, "response", None)}
