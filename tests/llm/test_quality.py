import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voxelgraph.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = quality.op10_quality(spark, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r.predicted == r.quality for r in held])
    print("auc", auc, "right", right, len(good), len(bad))
    assert auc > 0.95 and right > 0.93
    assert np.mean([r.predicted for r in held if r.quality == 1]) > 0.97
    assert out.count() == 1000 and out.where("score < 0 or score > 1 or score is null").count() == 0


def mixture(rng, n, share, d=20):
    """Features of n documents of which a share is good, and which of them are."""
    good = rng.random(n) < share
    x = np.zeros((n, quality.SIZE))
    x[:, :d] = rng.normal(0, 1, (n, d)) + np.where(good, 0.6, -0.6)[:, None]
    return x, good


def test_prior_is_found_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        u, truth = mixture(rng, 4000, share)
        p = mixture(rng, 1500, 1.0)[0]
        model = quality.train(p, u)
        assert abs(model.prior - share) < 0.06
        assert ((model.score(u) >= 0.5) == truth).mean() > 0.95


def test_risk_is_non_negative_and_least(spark):
    # few positives and many features: the plain unbiased risk goes below zero, the corrected one stays above
    rng = np.random.default_rng(5)
    p, u = (np.hstack([np.ones((n, 1)), rng.normal(m, 1, (n, 60))]) for n, m in ((40, 0.5), (90, 0.0)))
    w = quality.fit(p, u, 0.4, ridge=0.001)
    for_good, for_bad = quality.risk(p @ w, u @ w, 0.4)
    total = lambda v: sum((a := quality.risk(p @ v, u @ v, 0.4))[:1]) + max(0, a[1]) + 0.0005 * (v[1:] @ v[1:])
    assert for_bad >= 0 and for_good > 0
    start = np.zeros(len(w))
    assert total(w) < 0.1 * total(start)
    assert all(total(w) <= total(w + rng.normal(0, s, len(w))) + 0.01 for s in (0.01, 0.1, 0.5) for _ in range(50))


def test_labels_of_bad_documents_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.fitted(docs, labels), quality.fitted(docs, labels.where("quality = 1"))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_contradicting_and_repeated_labels(spark):
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}", 0) for i in ids + ids[:3]], "doc_id long, text string, least int")
    labels = spark.createDataFrame([(ids[0], 1), (ids[0], 0), (ids[1], 1), (ids[1], 1), (ids[2], None), (None, 1)], "doc_id long, quality int")
    p, u = quality.trusted(docs, labels)
    assert len(p) == 2 and len(u) == len(ids) + 3  # the second id's document is there twice


def test_nulls_nothing_to_learn_and_no_rows(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, "word " * 50_000, 3.0), (2, "word", 4.0)], "doc_id long, text string, x double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fitted(docs, none)
    assert [r[0] for r in docs.select(model.text_score(F.coalesce("text", F.lit("")))).collect()] == [0.5] * 4
    assert quality.fitted(docs.limit(0), none).prior == 0.5
    assert docs.limit(0).select(model.text_score(F.col("text"))).count() == 0


def features_by_hand(text):
    """The same features byte by byte and word by word."""
    raw = text.encode()
    if not raw:
        return [0.0] * quality.SIZE
    n, log = len(raw), lambda x: math.log1p(200 * x)
    letter = lambda b: chr(b).isalpha() and b < 128 or b >= 192
    letters, plain = sum(map(letter, raw)), b"\t\n\r !,.|"
    words, lines = raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    odd = sum(not letter(b) and not 48 <= b < 58 and not 128 <= b < 192 and b not in plain and b not in quality.MARKS for b in raw)
    shares = [sum(65 <= b < 91 for b in raw) / max(1, letters), sum(48 <= b < 58 for b in raw) / n, sum(b in quality.MARKS for b in raw) / n, *(raw.count(c) / n for c in (b"|", b"!", b"\n", b" ", b".", b",")), odd / n]
    more = [
        sum(map(len, words)) / m / 10, sum(len(w) > 20 for w in words) / m, len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        len(set(lines)) / len(lines), sum(w.isupper() for w in words) / m, sum(bool(re.match(rb"[A-Z]", w)) for w in words) / m,
    ]
    hashed = Counter(zlib.crc32(w.lower()) % quality.WORDS for w in words)
    runs = Counter((((a * 31 + b) * 31 + c) * 2654435761 % (1 << 32)) >> 25 for a, b, c in zip(raw, raw[1:], raw[2:]))
    return [math.log1p(n) / 10, *map(log, shares), *more, *(log(hashed[k] / m) for k in range(quality.WORDS)), *(log(runs[k] / n) for k in range(quality.RUNS))]


def slow_fit(p, u, prior, ridge):
    """Least non-negative risk by plain gradient descent with a slope that is halved when it doesn't pay."""

    def value(w):
        a, b = quality.risk(p @ w, u @ w, prior)
        return a + max(0.0, b) + ridge / 2 * (w[1:] @ w[1:])

    def slope(w):
        s = lambda f: 1 / (1 + np.exp(-f))
        g = -prior * (p * s(-(p @ w))[:, None]).mean(0)
        if quality.risk(p @ w, u @ w, prior)[1] > 0:
            g = g + (u * s(u @ w)[:, None]).mean(0) - prior * (p * s(p @ w)[:, None]).mean(0)
        g[1:] += ridge * w[1:]
        return g

    w, rate = np.zeros(p.shape[1]), 1.0
    for _ in range(4000):
        new = w - rate * slope(w)
        if value(new) < value(w):
            w, rate = new, rate * 1.1
        else:
            rate /= 2
    return w, value


def test_query_against_a_slow_fit_on_the_same_rows(spark):
    """Features, prior and scores of the whole query again, without Spark and by another optimiser."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    train = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5}
    bad = {r.doc_id for r in labels if r.quality != 1}
    good = {r.doc_id for r in labels if r.quality == 1} - bad
    x = {i: np.array(features_by_hand(t), "f4").astype("f8") for i, t in docs}
    u = np.array([x[i] for i, _ in docs if i in train])
    p = np.array([x[i] for i, _ in docs if i in train & good])
    mean, scale = u.mean(0), u.std(0)
    scale[scale < 1e-6] = 1.0
    model = quality.fitted(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert np.allclose(model.mean, mean, atol=1e-5) and np.allclose(model.scale, scale, atol=1e-4)
    design = lambda rows: np.hstack([np.ones((len(rows), 1)), np.clip((rows - mean) / scale, -6, 6)])
    w, value = slow_fit(design(p), design(u), model.prior, quality.RIDGE)
    assert value(model.weights) <= value(w) + 0.01
    score = dict(zip((i for i, _ in docs), 1 / (1 + np.exp(-design(np.array([x[i] for i, _ in docs])) @ w))))
    rows = quality.op10_quality(spark, SF).collect()
    # a risk with a part that can't be negative has no one minimum, so the two fits may part on single documents
    assert np.mean([r.predicted == (score[r.doc_id] >= 0.3) for r in rows]) > 0.9
    own = 1 / (1 + np.exp(-design(np.array([x[r.doc_id] for r in rows])) @ model.weights))
    assert np.allclose([r.score for r in rows], own, atol=1e-4) and all(r.predicted == (r.score >= 0.3) for r in rows)
