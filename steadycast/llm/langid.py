"""Language of a text by character models with interpolated Kneser-Ney smoothing.

Each language has its model; a text gets the language of the lowest cross-entropy per symbol.
The models are counted on part of the rows with a known language, and the score and the
rejection bounds are calibrated on the rest of them: the score is a logistic function of the
margin to the second language, fitted to all calibration rows by way of a histogram; a text is
``rejected`` when its entropy is above the language's bound or its score below one half.

Defined cases. Null texts and texts without a letter are ``und`` with score 0. Rows without a
language teach nothing. Without any teaching row all texts are ``und``. With one language only,
the margin counts as one bit. An empty table gives an empty table. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadycast.llm import charlm
from steadycast.llm.common import store

UNKNOWN = "und"
SCORED = "doc_id long, fold int, lang string, lang_pred string, entropy double, margin double"
BINS = 64


class Scorer:
    """Cross-entropies in all languages at once: a row of the table for each known 4-gram."""

    def __init__(self, models: dict[str, charlm.KneserNey]):
        self.langs, self.models = list(models), list(models.values())
        self.keys = np.unique(np.concatenate([m.keys[-1] for m in self.models]))
        self.logs = np.stack([m.log2(self.keys, charlm.ORDER) for m in self.models], axis=1)

    def entropies(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mean bits a symbol of each text (rows, all with symbols) in each language."""
        at, hit = charlm.find(self.keys, keys)
        bits = self.logs[at]
        if not hit.all():
            new, back = np.unique(keys[~hit], return_inverse=True)
            bits[~hit] = np.stack([m.log2(new, charlm.ORDER) for m in self.models], axis=1)[back]
        begins = np.cumsum(sizes) - sizes
        return -np.add.reduceat(bits, begins, axis=0, dtype=np.float64) / sizes[:, None]


def scores(docs: DataFrame, fold: Column, models: dict[str, charlm.KneserNey]) -> DataFrame:
    """Best language of each text, its entropy, and the margin to the next."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Scorer(models) if models else None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scorer = charlm.letters_table(), shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            pred = [UNKNOWN] * len(texts)
            entropy, margin = np.zeros(len(texts)), np.zeros(len(texts))
            for a, b in charlm.chunks(texts) if scorer else ():
                keys, sizes = charlm.keys_of(texts[a:b], table, True)
                # A text of spaces only has one key at most; what is a letter is asked of the text.
                rows = [i for i in range(b - a) if sizes[i] and any(map(str.isalpha, texts[a + i]))]
                if not rows:
                    continue
                if len(rows) < b - a:
                    keys, sizes = charlm.keys_of([texts[a + i] for i in rows], table, True)
                bits = scorer.entropies(keys, sizes)
                order = np.argsort(bits, axis=1, kind="stable")
                at = np.arange(len(rows))
                best = bits[at, order[:, 0]]
                second = bits[at, order[:, 1]] if bits.shape[1] > 1 else best + 1.0
                for i, r in enumerate(rows):
                    pred[a + r] = scorer.langs[order[i, 0]]
                entropy[a + np.array(rows)] = best
                margin[a + np.array(rows)] = second - best
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(pred, pa.string()), pa.array(entropy), pa.array(margin)],
                names=["doc_id", "fold", "lang", "lang_pred", "entropy", "margin"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), fold.cast("int").alias("fold"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(score, SCORED)


def logistic(x: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> tuple[float, float]:
    """Intercept and slope for counted right and wrong cases; both get a pseudo-case over all bins."""
    if not len(x):
        return 0.0, 1.0
    n = right + wrong
    hits = right + (right.sum() + 1) / (n.sum() + 2) * 0.5 / len(x)
    w = n + 0.5 / len(x)
    design = np.stack([np.ones(len(x)), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (hits - w * p) - 1e-3 * beta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def identify(docs: DataFrame, fold: Column, learn: tuple[int, ...], calibrate: tuple[int, ...], keep: float = 0.999) -> DataFrame:
    """``doc_id, fold, lang_pred, score, entropy, margin, rejected`` for every document.

    ``fold`` tells rows apart: models are counted on ``learn`` folds, scores and bounds are
    calibrated on ``calibrate`` folds, where a share ``keep`` of right texts stays in bounds.
    """
    known = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"), fold.alias("fold"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    grams = charlm.count_grams(known.where(F.col("fold").isin(*learn)), charlm.letters_table(), True)
    stored = store(scores(docs, fold, charlm.fit_all(grams, False)), "langid")

    squeezed = F.col("margin") / (F.col("margin") + 0.1)
    seen = stored.where(F.col("fold").isin(*calibrate) & F.col("lang").isNotNull() & (F.col("lang_pred") != UNKNOWN))
    right = F.col("lang") == F.col("lang_pred")
    bins = (
        seen.groupBy(F.floor(squeezed * BINS).alias("b"))
        .agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong")).orderBy("b").collect()
    )
    columns = np.array([[(r.b + 0.5) / BINS, r.right, r.wrong] for r in bins], dtype=float).reshape(-1, 3)
    intercept, slope = logistic(*columns.T)
    bounds = seen.where(right).groupBy("lang_pred").agg(F.percentile_approx("entropy", keep, 1000).alias("bound")).collect()
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(1 / (1 + F.exp(-(intercept + slope * squeezed))))
    bound = F.lit(float("inf"))
    for r in bounds:
        bound = F.when(F.col("lang_pred") == r.lang_pred, r.bound).otherwise(bound)
    out = stored.withColumn("score", score)
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("entropy") > bound) | (F.col("score") < 0.5)
    return out.select("doc_id", "fold", "lang_pred", "score", "entropy", "margin", rejected.alias("rejected"))
