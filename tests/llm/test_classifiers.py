import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loupe.llm.linear import FEATURES, bounded_sample, fit_ordinal, ordered, sigmoid
from loupe.llm.quality import QualityParams, events, fit_quality, keep_quality, score_quality
from loupe.llm.queries import op1_toxicity, op2_quality, table
from loupe.llm.textops import mix, span_hashes, utf8
from loupe.llm.toxicity import ToxicityParams, buckets, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"  # some 330 toxic texts to learn from; sf0.01 has 33


def feature_rows(spark, x, y):
    rows = [(int(g), 1.0, np.flatnonzero(v).astype(np.int32).tobytes(), v[v != 0].astype(np.float32).tobytes()) for v, g in zip(x, y)]
    return spark.createDataFrame(rows, FEATURES).repartition(3)


def test_ordinal_fit_recovers_weights_and_ordered_thresholds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4)).astype(np.float32)
    true, th = np.array([2.0, -1.0, 0.0, 0.5]), np.array([-1.0, 0.5, 2.0])
    noise = rng.logistic(size=len(x))
    y = ((x @ true + noise)[:, None] > th).sum(1)
    fit = fit_ordinal(feature_rows(spark, x, y), 4, 4, {g: float((y == g).sum()) for g in range(4)}, l2=1e-6, max_iter=60, tol=1e-7)
    assert np.allclose(fit.weights, true, atol=0.2) and np.allclose(fit.thresholds, th, atol=0.2)
    assert (np.diff(fit.thresholds) > 0).all()


def test_gradient_by_differences(spark):
    """The optimum of the fit is a stationary point of the likelihood, computed here directly."""
    rng = np.random.default_rng(1)
    x = (rng.random((300, 5)) < 0.5).astype(np.float32)
    y = rng.integers(0, 3, 300)
    fit = fit_ordinal(feature_rows(spark, x, y), 5, 3, {g: float((y == g).sum()) for g in range(3)}, l2=1e-3, max_iter=100, tol=1e-9)

    def loss(w, t):
        s = x @ w
        up, down = sigmoid(s - np.r_[-np.inf, t][y]), sigmoid(s - np.r_[t, np.inf][y])
        return -np.log(up - down).mean() + 5e-4 * w @ w

    w, t = fit.weights.astype(float), fit.thresholds
    for i in range(5):
        e = np.eye(5)[i] * 1e-2
        assert loss(w, t) <= loss(w + e, t) + 1e-5 and loss(w, t) <= loss(w - e, t) + 1e-5
    for i in range(2):
        e = np.eye(2)[i] * 1e-2
        assert loss(w, t) <= loss(w, t + e) + 1e-5 and loss(w, t) <= loss(w, t - e) + 1e-5


def test_sample_is_bounded_and_weighted(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = bounded_sample(df, [0, 1, 2], 500).groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    assert {r.y: (r.n, round(r.w)) for r in got} == {0: (500, 18_000), 1: (500, 2_000)}
    assert ordered(np.array([1.0, 0.0])).tolist() == [1.0, 2.0]


def test_buckets_do_not_depend_on_the_piece_size(monkeypatch):
    from loupe.llm import toxicity

    text = " ".join(f"word{i % 97} é" for i in range(700))
    slot = np.zeros(1 << 18, np.int32)
    whole = np.sort(buckets(text, (3, 4, 5), 18, slot))
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert np.array_equal(whole, np.sort(buckets(text, (3, 4, 5), 18, slot))) and len(np.unique(whole)) == len(whole)


def test_held_out_toxicity(spark):
    got = op1_toxicity(spark, LARGER).join(table(spark, LARGER, "labels").filter("toxic IS NOT NULL"), "doc_id").filter("held_out").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    auc = np.mean([[(t > c) + (t == c) / 2 for c in clean] for t in toxic])
    assert len(toxic) > 50 and auc > 0.96  # 0.978 measured; it grows with the labelled rows
    assert sum(r.predicted for r in got if r.toxic) > 0.45 * len(toxic)
    assert sum(r.predicted for r in got if not r.toxic) <= 0.01 * len(clean)


def test_held_out_quality(spark):
    got = op2_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    assert all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in got)


def test_labels_of_held_out_rows_change_nothing(spark, make_docs):
    rnd = random.Random(0)
    words = [f"w{i}" for i in range(50)]
    docs = make_docs([(i, " ".join(rnd.choices(words, k=20)) + (" nasty" if i % 3 == 0 else "")) for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id bigint, toxic int")
    other = labels.unionByName(spark.createDataFrame([(None, 1), (999, 1), (5, None)], "doc_id bigint, toxic int"))
    few = ToxicityParams(max_iter=4)
    a = score_toxicity(docs, fit_toxicity(docs, labels, few)).collect()
    b = score_toxicity(docs, fit_toxicity(docs, other, few)).collect()
    assert np.allclose([r.score for r in sorted(a)], [r.score for r in sorted(b)], atol=1e-4)


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0), (5, 0)], [(1, 1), (5, 0), (7, 0), (7, 1), (9, None)]])
def test_toxicity_of_awkward_rows(spark, awkward, no_docs, marks):
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = fit_toxicity(awkward, labels, ToxicityParams(max_iter=5))
    got = score_toxicity(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(no_docs, fit_toxicity(no_docs, labels)).count() == 0


@pytest.mark.parametrize("marks", [[], [(1, 2)], [(1, 0)], [(1, 1), (5, 0), (7, 2), (7, 5), (9, None)]])
def test_quality_of_awkward_rows(spark, awkward, no_docs, marks):
    ratings = spark.createDataFrame(marks, "doc_id bigint, grade int")
    model = fit_quality(awkward, ratings, QualityParams(max_iter=5))
    got = score_quality(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.p_tail <= 1 for r in got)
    kept = keep_quality(awkward, model)
    assert kept.columns == awkward.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (r.doc_id for r in got if r.p_tail >= 0.5)))
    assert score_quality(no_docs, fit_quality(no_docs, ratings)).count() == 0


def test_too_many_grades_are_refused(spark, make_docs):
    docs = make_docs([(i, "a") for i in range(20)])
    with pytest.raises(ValueError, match="grades"):
        fit_quality(docs, docs.select("doc_id", F.col("doc_id").cast("int").alias("grade")))


# ---------------------------------------------------------------- whole scores against plain Python

def plain_grams(text, lengths, bits):
    """Buckets of a text's character n-grams, one n-gram at a time."""
    words = (text or "").lower().split()
    if not words:
        return set()
    s, out = f" {' '.join(words)} ", set()
    for n in lengths:
        for i in range(len(s) - n + 1):
            h = ord(s[i])
            for c in s[i + 1:i + n]:
                h = (h * 0x01000193 + ord(c)) % 2 ** 32
            h ^= n * 0x9E3779B1 % 2 ** 32
            out.add(h * 0x85EBCA6B % 2 ** 32 >> 32 - bits)
    return out


def test_toxicity_equals_plain_python(spark, make_docs):
    """Counts, log ratios, the optimum and every score, recomputed without arrays of the module."""
    rnd = random.Random(2)
    nice, foul = ["sunny", "garden", "reads", "Book", "été"], ["vile", "scum", "rotten", "Hate"]
    rows = [(i, "  ".join(rnd.choices(nice + (foul if i % 3 == 0 else []), k=rnd.randint(0, 12)))) for i in range(90)] + [(90, None), (91, "")]
    p = ToxicityParams(bits=10, l2=1e-2, max_iter=200)
    docs, labels = make_docs(rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id bigint, toxic int")
    model = fit_toxicity(docs, labels, p)
    held = {i: plain_grams(t, p.lengths, p.bits) for i, t in rows}
    train = [(held[i], int(i % 3 == 0)) for i in range(80)]
    n = [sum(y == c for _, y in train) for c in (0, 1)]
    count = [[sum(y == c and j in g for g, y in train) for j in range(1 << p.bits)] for c in (0, 1)]
    ratio = [math.log((count[1][j] + p.smooth) / (n[1] + 2 * p.smooth)) - math.log((count[0][j] + p.smooth) / (n[0] + 2 * p.smooth)) for j in range(1 << p.bits)]
    weights, bias = model.fit.weights.astype(float), -float(model.fit.thresholds[0])
    score = {i: 1 / (1 + math.exp(-sum(weights[j] for j in g) - bias)) for i, g in held.items()}
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert got.keys() == score.keys() and all(math.isclose(got[i], score[i], abs_tol=1e-6) for i in got)
    # weights are ratio times what was learnt; the objective's slopes vanish there
    own = [w / r if abs(r) > 1e-12 else 0.0 for w, r in zip(weights, ratio)]
    miss = [score[i] - y for i, (_, y) in enumerate(train)]
    slopes = [ratio[j] * sum(m for (g, _), m in zip(train, miss) if j in g) / 80 + p.l2 * own[j] for j in range(1 << p.bits)]
    start = [ratio[j] * sum(n[1] / 80 - y for g, y in train if j in g) / 80 for j in range(1 << p.bits)]
    assert max(map(abs, slopes)) < 0.05 * max(map(abs, start)) and abs(sum(miss)) / 80 < 0.02


def plain_events(text, bits):
    """(word, shape, shape pair) buckets of every word, word by word; only the byte hash is shared."""
    def hashed(b):
        return int(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]) if b else 0

    def mixed(x):
        return int(mix(np.array([x % 2 ** 64], np.uint64))[0])

    def kind(c):
        return ord("a") if 97 <= c < 123 else ord("A") if 65 <= c < 91 else ord("0") if 48 <= c < 58 else 255 if c > 127 else c

    out, before, last = [], 0, None
    for w in (text or "").encode().split():
        kinds = [kind(c) for c in w]
        shape = hashed(bytes(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]))
        word = hashed(w)
        pair = mixed(before * 0x9E3779B97F4A7C15 % 2 ** 64 ^ (shape + (word == last)) % 2 ** 64)
        out.append([x >> 64 - bits for x in (word, mixed(shape ^ 0xA5A5A5A5), mixed(pair ^ 0x5A5A5A5A5A))])
        before, last = shape, word
    return out


def test_quality_equals_plain_python(spark, make_docs):
    rnd = random.Random(3)
    bits = ["word", "word", "Word", "ABC", "a1b22", "$$", "été", "x-y", "...", "日本", "!!a", "ÀB"]
    texts = ["".join(rnd.choice(bits) + rnd.choice([" ", "  ", "\n", "\t"]) for _ in range(rnd.randint(0, 15))) for _ in range(120)] + [None, "", " \n"]
    data, off = utf8(pa.array(texts))
    got, first = events(data, off, 16)
    want = [plain_events(t, 16) for t in texts]
    assert [got[a:z].tolist() for a, z in zip(first, first[1:])] == want
    docs = make_docs(list(enumerate(texts)))
    model = fit_quality(docs, spark.createDataFrame([(i, i % 3) for i in range(100)], "doc_id bigint, grade int"), QualityParams(bits=12, max_iter=5))
    w, th = model.fit.weights.astype(float), model.fit.thresholds
    for r in score_quality(docs, model, least=2).collect():
        each = plain_events(texts[r.doc_id], 12)
        s = model.params.gain * sum(w[j] for e in each for j in e) / max(len(each), 1)
        above = [1 / (1 + math.exp(t - s)) for t in th]
        assert math.isclose(r.p_tail, above[1], abs_tol=1e-5) and math.isclose(r.expected_grade, sum(above), abs_tol=1e-5)
