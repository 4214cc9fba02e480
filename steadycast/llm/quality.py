"""Quality classifier learned from trusted positives and unlabelled text.

The risk is the non-negative unbiased one: with class prior p, loss on positives is weighted by
p, and the loss of unlabelled text as negatives is corrected by the positives in it, never below
zero. The scores are then calibrated on labelled rows of both kinds. Features are shares of
signs and a few counts of words and lines; only text is read.

The fit uses bounded samples (``positives``, ``unlabelled``, ``calibration`` rows at most, those
with the least hash of the id). The class prior is counted over all teaching labels. Scores are
given to all rows.

Defined cases. A null text is an empty one and is scored. Null labels teach nothing; labels
without a document neither. Without teaching positives or without documents every score is the
class prior (0.5 without any label). Repeated rows are scored alike. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.llm import charlm
from steadycast.llm.common import WordHashes, nullable, utf8
from steadycast.llm.rules import repeated_lines, repeated_words

MEASURES = 7


def features(texts: list[str], table: np.ndarray, known: WordHashes) -> np.ndarray:
    """Shares of the folded signs, their logarithms, and measures of words and lines."""
    shares = np.zeros((len(texts), charlm.SYMBOLS), np.float32)
    more = np.zeros((len(texts), MEASURES), np.float32)
    split = [utf8(t).split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.array([known[w] for ws in split for w in ws], dtype=np.uint64)
    again = repeated_words(words, sizes)
    for i, (t, ws) in enumerate(zip(texts, split)):
        if not t:
            continue
        shares[i] = np.bincount(table[charlm.units(t)], minlength=charlm.SYMBOLS) / len(t)
        lines = t.count("\n") + 1
        more[i] = (
            np.log1p(len(t)), len(ws) / len(t), len(set(ws)) / max(len(ws), 1), again[i] / max(len(ws), 1),
            repeated_lines(t) / lines, np.log1p(len(t) / lines), 0,
        )
        seen = shares[i][shares[i] > 0]
        more[i, 6] = -(seen * np.log2(seen)).sum()
    return np.hstack([shares, np.log(shares + np.float32(1e-3)), more])


def _feature_rows(rows: DataFrame) -> DataFrame:
    """(kind, features) of rows (kind, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = charlm.text_table(), WordHashes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in charlm.chunks(texts):
                x = features(texts[a:b], table, known)
                cells = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), cells], names=["kind", "x"])

    return rows.mapInArrow(make, "kind string, x array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Linear model of least non-negative risk with logistic loss."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    xp, xu = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = np.zeros(both.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
        # Gradient of the loss as positive is s - 1, as negative s.
        negative = np.logaddexp(0, xu @ w + b).mean() - prior * np.logaddexp(0, xp @ w + b).mean()
        gp = prior * (sp - 1) / len(xp)
        gn_p, gn_u = -prior * sp / len(xp), su / len(xu)
        if negative < 0:  # the correction has overshot: step back on it alone
            gp, gn_p, gn_u = np.zeros_like(gp), -gn_p, -gn_u
        rp, ru = (gp + gn_p).astype(np.float32), gn_u.astype(np.float32)
        g = np.append(xp.T @ rp + xu.T @ ru + ridge * w, rp.sum() + ru.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return Model(mean, scale, w, b)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """Slope and intercept of the log-odds fitted to labelled rows, weighted to the class prior."""
    if not 0 < y.sum() < len(y):
        return model
    z = (x - model.mean) / model.scale @ model.weights + model.bias
    z = np.clip(z.astype(np.float64), -30, 30)
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    design, beta = np.stack([np.ones(len(z)), z], axis=1), np.array([0.0, 1.0])
    for _ in range(30):
        p = sigmoid(design @ beta)
        g = design.T @ (weight * (target - p)) - 1e-3 * (beta - [0, 1])
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(float(beta[1]), 1e-3)
    return Model(model.mean, model.scale, model.weights * np.float32(slope), model.bias * slope + float(beta[0]))


def _least(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def learn(
    docs: DataFrame, labels: DataFrame, positives: int = 12_000, unlabelled: int = 12_000, calibration: int = 6_000
) -> Model | float:
    """Fit on ``labels`` (doc_id, quality), which must be the teaching rows only.

    Returns the class prior when there is nothing to fit.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality in (0, 1) and doc_id is not null")
    count = known.agg(F.count("*").alias("n"), F.sum("quality").alias("good")).first()
    prior = min(max(count.good / count.n, 0.01), 0.99) if count.n else 0.5
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    good, bad = known.where("quality = 1"), known.where("quality = 0")
    picked = (
        _least(good.select("doc_id"), positives).withColumn("kind", F.lit("positive"))
        .union(_least(texts.select("doc_id"), unlabelled).withColumn("kind", F.lit("unlabelled")))
        .union(_least(bad.select("doc_id"), calibration).withColumn("kind", F.lit("negative")))
    ).distinct()
    # At most the three bounds in rows: small enough to broadcast.
    table = _feature_rows(texts.join(F.broadcast(picked), "doc_id").select("kind", "text")).toArrow()
    kind = np.array(table["kind"].to_pylist(), dtype=object)
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(kind), -1) if len(kind) else np.zeros((0, 1), np.float32)
    xp, xu, xn = (x[kind == k] for k in ("positive", "unlabelled", "negative"))
    if not len(xp) or not len(xu):
        return prior
    model = fit(xp, xu, prior)
    xc = np.vstack([xp[:calibration], xn])
    return calibrate(model, xc, np.append(np.ones(len(xc) - len(xn)), np.zeros(len(xn))), prior)


def _scores(model: Model | float, texts: list[str], table: np.ndarray, known: WordHashes) -> np.ndarray:
    out = np.empty(len(texts))
    for a, b in charlm.chunks(texts):
        out[a:b] = model if isinstance(model, float) else model.scores(features(texts[a:b], table, known))
    return out


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = charlm.text_table(), WordHashes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, texts, table, known))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model | float, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = charlm.text_table(), WordHashes()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(_scores(shared.value, texts, table, known) >= threshold))

    return docs.mapInArrow(run, nullable(docs))
