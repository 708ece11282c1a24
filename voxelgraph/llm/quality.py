"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are the documents labelled as good; all training documents are the unlabelled mixture. Nothing
is learnt from a label that says bad; only an id that is labelled both ways loses its trust. With the class prior pi, the share of good documents in the mixture, the
risk of a linear score f is pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)]), l the logistic loss. Where
the second part, an estimate of a risk that can't be negative, falls below 0, a step goes back up its
gradient instead of down the whole (the non-negative correction); the weights of the least risk seen whose
second part isn't below 0 are kept.

The prior is estimated from positives and unlabelled documents alone: a score is fitted that tells the one half
of them apart; on the other half, wherever a threshold is, the mixture's share above it is at least pi times the
positives' share above it. The least such ratio, with an allowance for small counts, is the estimate.

The fit takes a bounded sample, ``POSITIVES`` trusted and ``UNLABELLED`` other training documents, of which only
features reach the driver; texts are scored in one pass over all documents. Scores use whole texts only: no
labels, ids, languages or sources.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.llm.tokens import text_of
from voxelgraph.session import staged, table

#: Surface features of a text, in order; behind them come hashed words and hashed runs of three bytes.
NAMES = ("length", "capitals", "digits", "marks", "bars", "bangs", "breaks", "spaces", "stops", "commas", "other", "word_length", "long_words", "fresh_words", "repeats", "fresh_lines", "loud_words", "first_capitals")
WORDS, RUNS = 128, 128
SIZE = len(NAMES) + WORDS + RUNS
SMOOTH = 200.0
MARKS = b"#$%&*=~^_{}<>\\@"
#: Documents that the fit may take, at most about: trusted ones, and training ones as unlabelled.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Steps of the fit, their size, and the ridge.
STEPS, RATE, RIDGE = 400, 0.03, 0.003


def features(text: str) -> np.ndarray:
    """What a text is made of, as log-scaled shares; an empty text has zeros."""
    raw = text.encode()
    if not raw:
        return np.zeros(SIZE, "f4")
    seen = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    letters = int(seen[65:91].sum() + seen[97:123].sum() + seen[192:].sum())
    n = len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    plain = int(seen[48:58].sum()) + letters + int(seen[128:192].sum()) + int(seen[[9, 10, 13, 32, 33, 44, 46, 124]].sum())
    capitals = int(seen[65:91].sum())
    marks = int(seen[list(MARKS)].sum())
    lengths = np.fromiter(map(len, words), "i4", len(words)) if words else np.zeros(1, "i4")
    share = (
        capitals / max(1, letters),
        int(seen[48:58].sum()) / n,
        marks / n,
        int(seen[124]) / n,
        int(seen[33]) / n,
        int(seen[10]) / n,
        int(seen[32]) / n,
        int(seen[46]) / n,
        int(seen[44]) / n,
        max(0, n - plain - marks) / n,
    )
    more = (
        float(lengths.mean()) / 10,
        float((lengths > 20).mean()),
        len(set(words)) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        len(set(lines)) / len(lines),
        sum(map(bytes.isupper, words)) / m,
        sum(w[:1].isupper() for w in words) / m,
    )
    each = np.fromiter(map(zlib.crc32, map(bytes.lower, words)), "u4", len(words)) % WORDS
    b = np.frombuffer(raw, "u1").astype("u4")
    runs = ((b[:-2] * 31 + b[1:-1]) * 31 + b[2:]) * np.uint32(2654435761) >> np.uint32(25)
    hashed = np.concatenate([np.bincount(each, minlength=WORDS) / m, np.bincount(runs, minlength=RUNS) / n])
    return np.concatenate([[np.log1p(n) / 10], np.log1p(SMOOTH * np.array(share)), more, np.log1p(SMOOTH * hashed)]).astype("f4")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measured(texts: DataFrame) -> np.ndarray:
    """The features of each text of a bounded table (``text``), a row for each; they are what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()).tobytes() for t in batch.column(0)], pa.binary())], names=["x"])

    rows = texts.select(text_of().alias("text")).mapInArrow(run, "x binary").toArrow().column("x").to_pylist()
    return np.frombuffer(b"".join(sorted(rows)), "f4").reshape(-1, SIZE).astype("f8")


def _some(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows by a hash of the whole text, the same on every run; all where there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    part = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n)
    return rows.where(part).limit(2 * most)  # a bound even if one row repeats without end


def trusted(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features of trusted positives and of unlabelled training documents.

    Only labels of rows that aren't held out count, and only those that say good; an id that is also labelled
    as bad is not trusted. Documents that repeat an id are all trusted.
    """
    training = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1 and doc_id is not null").select("doc_id")
    good = _some(good.where(~held_out(F.col("doc_id"))).withColumn("text", F.lit("")), positives).select("doc_id")
    chosen = training.join(F.broadcast(staged(good)), "doc_id", "left_semi").limit(2 * positives)  # at most 2 * positives ids
    return measured(chosen), measured(_some(training, unlabelled))


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), x.shape[1] + 1))
    z = out[:, 1:]  # in place: the driver holds no copies of all features
    np.subtract(x, mean, out=z)
    z /= scale
    np.clip(z, -6, 6, out=z)
    return out


def _loss(f: np.ndarray) -> np.ndarray:
    """Logistic loss of scores that should be positive."""
    return np.logaddexp(0, -f)


def risk(positive: np.ndarray, mixture: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk, from scores of positives and of the mixture."""
    return prior * _loss(positive).mean(), _loss(-mixture).mean() - prior * _loss(-positive).mean()


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the least risk seen whose second part isn't below 0, from designs (a first column of ones) of positives and mixture."""
    w = np.zeros(p.shape[1])
    w[0] = np.log(prior / (1 - prior))
    best, least = w, (True, np.inf)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        for_good, for_bad = risk(fp, fu, prior)
        total = for_bad < 0, for_good + max(0.0, for_bad) + ridge / 2 * (w[1:] @ w[1:])
        if total < least:
            best, least = w.copy(), total
        bad = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp) / len(p))
        gradient = -bad if for_bad < 0 else bad - prior * (p.T @ _sigmoid(-fp) / len(p))
        gradient[1:] += ridge * w[1:]
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w = w - rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return best


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in the mixture, from designs of both; every second row is held back from the score."""
    score = fit(p[::2], u[::2], 0.5, STEPS // 4)
    good, mixed = np.sort(p[1::2] @ score), np.sort(u[1::2] @ score)
    if not len(good) or not len(mixed):
        return 0.5
    above = lambda x: 1 - np.searchsorted(x, good) / len(x)
    ratio, slack = above(mixed) / above(good), (np.sqrt(np.log(40) / 2 / len(mixed)) + np.sqrt(np.log(40) / 2 / len(good))) / above(good)
    return float(np.clip(ratio[np.argmin(ratio + slack)], 0.02, 0.98))


class Model:
    """Standardisation and weights; ``score`` maps features to 0..1."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_design(x, self.mean, self.scale) @ self.weights)

    def text_score(self, text: Column) -> Column:
        """A column of scores for whole texts."""
        model = self

        @F.pandas_udf("double")
        def score(t):
            import pandas as pd

            return pd.Series(model.score(np.array([features(x) for x in t])) if len(t) else [], dtype="float64")

        return score(text)


def train(positive: np.ndarray, mixture: np.ndarray) -> Model:
    """Fit on features of trusted positives and of the mixture.

    Without a row of either there is nothing to learn: weights 0, every score 0.5.
    """
    if not len(positive) or not len(mixture):
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE + 1), 0.5)
    mean, scale = mixture.mean(0), mixture.std(0)
    scale[scale < 1e-6] = 1.0
    # rows come sorted by their features; mixed, so that every second one is a fair half
    mixed = np.random.default_rng(0)
    p, u = (_design(x[mixed.permutation(len(x))], mean, scale) for x in (positive, mixture))
    prior = class_prior(p, u)
    return Model(mean, scale, fit(p, u, prior), prior)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, quality``)."""
    return train(*trusted(docs, labels))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, scored on whole texts; 1 where the score is at least 0.3.

    One row for each row, repeated ids included; a null text scores as an empty one, very long ones are read
    whole, an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.text_score(text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
