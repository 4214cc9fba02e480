"""Quality rules: counts of words, signs, repeated lines and windows, and perplexity bands.

A character model with modified Kneser-Ney smoothing is counted by Spark for each language over
all texts that are mostly words in any script, or all texts of a language that has none of
these; so every language with text has a model and a band. A document is kept when it passes the base rules and its bits
a symbol lie inside the band of its language, which is taken from the scores of all documents.

Defined cases. A null text has no words and fails the base rules. Documents without a language
form a language of their own. A language without any text has no model and no band, and
nothing in it passes the base rules. Repeated rows are judged alike. An empty table gives an empty table. Texts are
used whole. Of a language, only discounts and a band are broadcast; see ``gramtable`` for its model.
Texts are dealt out in chunks of bounded size, compressed by task and chunk; a chunk gets the scores of its distinct
grams, of which a large chunk has fewer for its length, so less is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.llm import charlm, gramtable
from steadycast.llm.common import WordHashes, mix64, store, utf8

SIGNS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
NO_LANG = "und"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
CHUNKS, CHUNK_CHARS = 64, 1 << 23


def repeated_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it.

    ``words`` are the hashes of all texts on end, ``sizes`` their numbers.
    """
    out = np.zeros(len(sizes), np.int64)
    if len(words) < WINDOW:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = np.zeros(len(words) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        key = mix64(key + words[k : len(key) + k] + np.uint64(k + 1))
    inside = np.flatnonzero(doc[: len(key)] == doc[WINDOW - 1 :])
    key = key[inside] ^ mix64(doc[inside].astype(np.uint64) + np.uint64(1))
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    starts = inside[n[back] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[starts + k] = True
    np.add.at(out, doc[covered], 1)
    return out


def base_counts(texts: list[str], known: WordHashes) -> np.ndarray:
    """The columns of ``COUNTS``, a row for each text."""
    split = [utf8(t).split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.array([known[w] for ws in split for w in ws], dtype=np.uint64)
    rows = np.zeros((len(texts), 5), np.int64)
    rows[:, 0] = sizes
    for i, t in enumerate(texts):
        rows[i, 1] = len(t) - sum(map(t.count, SPACES))
        rows[i, 2] = sum(map(t.count, SIGNS))
        rows[i, 3] = repeated_lines(t)
    rows[:, 4] = repeated_words(words, sizes)
    return rows


def mostly_words(text: str = "text", share: float = 0.02):
    """Few signs, and at least half of it letters that are no capitals, in any script."""
    c = F.col(text)
    # Small ASCII letters go first by a plain range: the classes of all scripts and the signs are then sought in the little that is left.
    left = F.regexp_replace(c, "[a-z]+", "")
    signs = F.length(left) - F.length(F.regexp_replace(left, f"[{SIGNS}]+", ""))
    letters = F.length(c) - F.length(F.regexp_replace(left, r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", ""))
    return (signs <= share * F.length(c)) & (2 * letters >= F.length(c))


def judge(docs: DataFrame, quantile: float = 0.005, reach: float = 1.5, slack: float = 3.0) -> DataFrame:
    """Counts, bits a symbol, ``base_failed``, ``in_band`` and ``kept`` for every document.

    A band reaches ``reach`` times as far from the median as the outer quantiles of the texts
    that are mostly words, and ``slack`` bits, divided by the root of the length, farther: the
    mean over a short text scatters more.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.col("text").cast("string"),
    )
    rows = rows.withColumn("plain", F.coalesce(mostly_words(), F.lit(False)))
    held = rows.groupBy("lang").agg(F.max("plain").alias("any"), F.sum(F.length("text")).alias("chars"))
    held = store(held, "langs")
    # A language without such texts is modelled on all it has.
    odd = held.where(~F.col("any")).select("lang", F.lit(True).alias("odd"))
    rows = rows.join(F.broadcast(odd), "lang", "left")
    rows = rows.withColumn("plain", F.col("plain") | (F.col("odd").isNotNull() & F.col("text").isNotNull()))
    model = gramtable.fit(gramtable.count(rows))

    chars = held.agg(F.sum("chars")).first()[0] or 0
    chunks = max(CHUNKS, -(-chars // CHUNK_CHARS))
    chunk = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(chunks)).alias("chunk")
    dealt = gramtable.pack(rows.select(chunk, "doc_id", "lang", "text", "plain")).repartition("chunk")
    looked = gramtable.look_up(dealt, model)

    def score(looked: pa.Table, packed: pa.Table) -> pa.Table:
        docs = gramtable.unpacked(packed)
        langs, texts = docs["lang"].to_pylist(), [t or "" for t in docs["text"].to_pylist()]
        known = WordHashes()
        counts = [base_counts(texts[a:b], known) for a, b in charlm.chunks(texts)]
        counts = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *counts])
        bits = pa.array(gramtable.bits_of(langs, texts, looked), from_pandas=True)
        return pa.table(
            [docs["doc_id"], docs["lang"], docs["plain"], bits, *(pa.array(c) for c in counts.T)],
            names=["doc_id", "lang", "plain", "bits", *COUNTS],
        )

    schema = "doc_id long, lang string, plain boolean, bits double, " + ", ".join(f"{c} long" for c in COUNTS)
    stored = store(looked.groupBy("chunk").cogroup(dealt.groupBy("chunk")).applyInArrow(score, schema), "rules")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    at = F.array(*map(F.lit, (quantile, 0.5, 1 - quantile)))
    # Where no text that the model is counted on passes the base rules, others give the band.
    choices = [F.when(which, F.col("bits")) for which in (F.col("plain") & ~failed, ~failed, F.lit(True))]
    edges = stored.where(F.col("bits").isNotNull()).groupBy("lang").agg(
        F.coalesce(*(F.percentile_approx(c, at, 10000) for c in choices)).alias("q")
    )
    low = F.col("q")[1] - reach * (F.col("q")[1] - F.col("q")[0])
    high = F.col("q")[1] + reach * (F.col("q")[2] - F.col("q")[1])
    bands = store(edges.select("lang", low.alias("low"), high.alias("high")), "bands")
    more = F.try_divide(F.lit(slack), F.sqrt(F.col("word_chars") + F.col("n_words")))
    inside = F.coalesce(F.col("bits").between(F.col("low") - more, F.col("high") + more), F.lit(True))
    stored = stored.join(F.broadcast(bands), "lang", "left")
    return stored.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"), "bits", inside.alias("in_band"),
    )
