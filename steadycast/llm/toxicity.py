"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence has a logistic score of its words; a document is toxic if any sentence is, so the
scores combine by noisy-or. Only document labels teach; the sentence scores then locate the
offending sentences.

The fit uses the ``sample`` labelled documents with the least hash of the id, in their natural
share of classes, and words, or beginnings of words, found in ``least_docs`` of them or more. Scores are given to all rows.

Defined cases. A null or empty text, or one without a sentence, has score 0. Null labels and
labels without a document teach nothing. Without teaching labels of both kinds every score is 0.
Repeated rows are scored alike. An empty table gives an empty table. Texts are used whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    words: dict[str, float]
    bias: float


def _sentences(text: str) -> list[list[str]]:
    return [words for s in SENTENCE.findall(text.lower()) if (words := WORD.findall(s))]


def signs(word: str) -> list[int]:
    """Hashes of a word and of its beginnings, which inflected forms share: four for any word."""
    forms = [word, *(f"{word[:n]}~" for n in (4, 5, 6))]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in forms]


def _flat(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Signs of a text on end, and where its sentences end."""
    found = [[h for w in s for h in signs(w)] for s in _sentences(text or "")]
    return np.array([h for s in found for h in s], np.int64), np.cumsum([len(s) for s in found], dtype=np.int64)


def _count_signs(rows: DataFrame) -> DataFrame:
    """(sign, n, bad): documents, and toxic ones, that have a sign; rows are (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_pylist()
            for start in range(0, batch.num_rows, 500):
                own = [np.unique(_flat(t)[0]) for t in batch.column(1).slice(start, 500).to_pylist()]
                bad = np.repeat(toxic[start : start + 500], [len(o) for o in own])
                kinds, back = np.unique(np.concatenate(own), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds), pa.array(np.bincount(back, minlength=len(kinds))),
                     pa.array(np.bincount(back, bad, len(kinds)).astype(np.int64))],
                    names=["sign", "n", "bad"],
                )

    counted = rows.mapInArrow(run, "sign long, n long, bad long")
    return counted.groupBy("sign").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _instances(rows: DataFrame, telling: np.ndarray) -> DataFrame:
    """(toxic, sentences, at, sign): of a document, where its telling signs stand and which they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sentences, at, sign = [], [], []
            for text in batch.column(1).to_pylist():
                flat, ends = _flat(text)
                place = np.minimum(np.searchsorted(telling, flat), len(telling) - 1)
                hit = np.flatnonzero(telling[place] == flat)
                sentences.append(len(ends))
                at.append(np.searchsorted(ends, hit, side="right"))
                sign.append(place[hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sentences, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(sign, pa.list_(pa.int64()))],
                names=["toxic", "sentences", "at", "sign"],
            )

    return rows.mapInArrow(run, "toxic int, sentences long, at array<long>, sign array<long>")


def fit(
    doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, toxic: np.ndarray, prior: np.ndarray,
    steps: int = 300, rate: float = 0.1, pull: float = 0.05,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentence score, from document labels.

    ``word`` lies in ``sentence``; ``doc`` gives the document of each sentence. With the
    sentence score s = sigmoid(z), one minus the noisy-or is exp(-sum softplus(z)). The weights
    start at ``prior`` and are drawn to it: from zero, a sentence among many hardly moves, and a
    sign that never is the only one in its document would learn nothing.
    """
    n_sentences, n_docs = len(doc), len(toxic)
    size, w = len(prior), prior.copy()
    share = min(max(toxic.mean(), 1e-3), 1 - 1e-3)
    b = float(np.log(np.expm1(-np.log1p(-share) * n_docs / max(n_sentences, 1))))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(sentence, w[word], n_sentences) if len(word) else np.full(n_sentences, b)
        z = np.clip(z, -30, 30)
        total = np.bincount(doc, np.logaddexp(0, z), n_docs)
        per_doc = np.where(toxic == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0) / n_docs
        gz = per_doc[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(word, gz[sentence], size) + pull / n_docs * (w - prior), gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        root = np.sqrt(v / (1 - 0.999**step)) + 1e-6
        move = rate * (m / (1 - 0.9**step)) / root
        w = w - move[:-1]
        b -= float(move[-1])
    return w, b


def learn(docs: DataFrame, labels: DataFrame, sample: int = 15_000, least_docs: int = 6, least_z: float = 6.0) -> Model | None:
    """Fit on ``labels`` (doc_id, toxic), which must be the teaching rows only.

    Signs take part when they are in ``least_docs`` documents, of which more are toxic than
    chance would give, by ``least_z`` standard deviations: others could only explain noise.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic in (0, 1) and doc_id is not null")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)  # a bounded table
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(picked), "doc_id").select("toxic", "text")
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not total.n or not 0 < total.bad < total.n:
        return None
    share = total.bad / total.n
    chance = F.col("n") * share
    telling = _count_signs(rows).where(
        (F.col("n") >= least_docs) & (F.col("bad") - chance >= least_z * F.sqrt(chance * (1 - share)))
    ).orderBy("sign").toArrow()
    known, n, bad = (telling[c].to_numpy() for c in ("sign", "n", "bad"))
    if not len(known):
        return None
    table = _instances(rows, known).toArrow()
    toxic, sentences = table["toxic"].to_numpy(), table["sentences"].to_numpy()
    begins = np.cumsum(sentences) - sentences
    at, sign = table["at"].combine_chunks(), table["sign"].combine_chunks()
    sentence = at.flatten().to_numpy() + np.repeat(begins, np.diff(at.offsets.to_numpy()))
    # Half the log-odds: a word has four signs, and two that tell should be enough.
    prior = 0.5 * np.log((bad + 0.5) / (n - bad + 0.5))
    doc = np.repeat(np.arange(len(toxic)), sentences)
    w, bias = fit(doc, sentence, sign.flatten().to_numpy(), toxic, prior)
    return Model(dict(zip(known.tolist(), w.tolist())), bias)


class Scorer:
    """Looks words up by their hash, remembered per word."""

    def __init__(self, model: Model):
        self.model, self.memory = model, {}

    def weight(self, word: str) -> float:
        value = self.memory.get(word)
        if value is None:
            if len(self.memory) >= 1 << 19:
                self.memory.clear()
            value = sum(self.model.words.get(h, 0.0) for h in signs(word))
            self.memory[word] = value
        return value

    def document(self, text: str) -> tuple[float, list[dict]]:
        """Score, and the sentences that alone make the document toxic."""
        total, spans = 0.0, []
        lower = text.lower()
        same = len(lower) == len(text)  # a few letters change length
        for s in SENTENCE.finditer(lower):
            words = WORD.findall(s.group())
            if not words:
                continue
            z = self.model.bias + sum(map(self.weight, words))
            soft = z if z > 30 else float(np.log1p(np.exp(z)))
            total += soft
            p = 1 - np.exp(-soft)
            if p >= 0.5:
                start, end = s.span() if same else _span(text, len(spans), s)
                spans.append({"start": start, "length": end - start, "score": float(p)})
        return float(1 - np.exp(-total)), spans


def _span(text: str, _: int, match: re.Match) -> tuple[int, int]:
    """Span in a text whose lower-cased form has another length: the sentence of equal rank."""
    rank = sum(1 for _ in SENTENCE.finditer(match.string[: match.start()]))
    for i, s in enumerate(SENTENCE.finditer(text)):
        if i == rank:
            return s.span()
    return 0, 0


OFFENDING = "array<struct<start:long,length:long,score:double>>"
OFFENDING_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, offending) of every row; spans count code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            found = [scorer.document(t) if scorer and t else (0.0, []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], OFFENDING_ARROW)],
                names=["doc_id", "score", "offending"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, score double, offending {OFFENDING}")
