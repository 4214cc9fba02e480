"""Character models with interpolated Kneser-Ney smoothing, stored in sorted arrays.

A symbol is a code unit folded into six bits, a 4-gram key is 24 bits wide. So a model has at
most 2^24 keys of four bytes and as many probabilities: that bound holds for any corpus, and is
what allows a model to be collected and broadcast. Spark counts the 4-grams of all texts;
counts of lower orders are numbers of distinct left neighbours, and follow from the 4-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, ORDER = 6, 4
SYMBOLS = 1 << BITS
CHUNK_CHARS = 1 << 21


def letters_table() -> np.ndarray:
    """Case is dropped, all that is no letter becomes a space (0)."""
    table = np.zeros(1 << 16, np.uint8)
    for unit in range(1 << 16):
        c = chr(unit).lower()[:1]
        if 0xD800 <= unit < 0xE000:
            table[unit] = 27 + unit % 37
        elif c.isalpha():
            table[unit] = ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37
    return table


def text_table() -> np.ndarray:
    """All signs count: letters, capitals, digits, marks by groups, line ends."""
    table = np.empty(1 << 16, np.uint8)
    for unit in range(1 << 16):
        c = chr(unit)
        if c == "\n":
            table[unit] = 29
        elif c.isspace():
            table[unit] = 0
        elif "a" <= c <= "z":
            table[unit] = ord(c) - 96
        elif "A" <= c <= "Z":
            table[unit] = 27
        elif c.isdigit():
            table[unit] = 28
        elif c in ".,":
            table[unit] = 30 + (c == ",")
        elif c.isalpha() or 0xD800 <= unit < 0xE000:
            table[unit] = 40 + ord(c.lower()[0]) % 24
        else:
            table[unit] = 32 + unit % 8
    return table


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")


def keys_of(texts: list[str], table: np.ndarray, squeeze: bool) -> tuple[np.ndarray, np.ndarray]:
    """4-gram keys of all texts, and how many keys each text has.

    Each text begins after three spaces. ``squeeze`` folds runs of spaces into one.
    """
    parts, sizes = [], []
    for text in texts:
        s = table[units(text)]
        if squeeze and len(s):
            s = s[(s != 0) | np.append(True, s[:-1] != 0)]
        parts += [np.zeros(ORDER - 1, np.uint8), s]
        sizes.append(len(s))
    count = np.array(sizes, np.int64)
    if not parts or not count.sum():
        return np.empty(0, np.uint32), count
    s = np.concatenate(parts).astype(np.uint32)
    keys = s[:-3] << 18 | s[1:-2] << 12 | s[2:-1] << 6 | s[3:]
    # Key i predicts symbol i + 3; those of the padding of later texts are left out.
    keep = np.ones(len(s), bool)
    begins = np.cumsum(count + ORDER - 1) - (count + ORDER - 1)
    for k in range(ORDER - 1):
        keep[begins + k] = False
    return keys[keep[ORDER - 1 :]], count


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_CHARS`` characters, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > CHUNK_CHARS:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def count_grams(docs: DataFrame, table: np.ndarray, squeeze: bool) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (lang, text); texts are not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for a, b in chunks(texts):
                    grams, n = np.unique(keys_of(texts[a:b], table, squeeze)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(n)],
                        names=["lang", "gram", "n"],
                    )

    grams = docs.select("lang", "text").mapInArrow(count, "lang string, gram int, n long")
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """One language: sorted keys with log2 probabilities per order, and weights of contexts."""

    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)  # log2 of the mass left to the lower order

    @classmethod
    def fit(cls, grams: np.ndarray, counts: np.ndarray, modified: bool) -> KneserNey:
        """From sorted distinct 4-grams. ``modified``: three discounts an order, else one."""
        levels = [(grams, counts)]
        for order in range(ORDER - 1, 0, -1):  # continuation counts
            levels.insert(0, np.unique(levels[0][0] & (1 << BITS * order) - 1, return_counts=True))
        model = cls()
        for keys, n in levels:
            keys = keys.astype(np.uint32)
            n = n.astype(np.float64)
            context, first = np.unique(keys >> BITS, return_index=True)
            total = np.add.reduceat(n, first)
            size = np.diff(np.append(first, len(keys)))
            cut = discounts(n, modified)[np.minimum(n, 3).astype(np.int64)]
            weight = np.maximum(np.add.reduceat(np.minimum(cut, n), first) / total, 1e-9)
            lower = np.exp2(model.log2(keys & (1 << BITS * len(model.keys)) - 1, len(model.keys)))
            p = np.maximum(n - cut, 0) / np.repeat(total, size) + np.repeat(weight, size) * lower
            model.keys.append(keys)
            model.logs.append(np.log2(p).astype(np.float32))
            model.contexts.append(context)
            model.weights.append(np.log2(weight).astype(np.float32))
        return model

    def log2(self, keys: np.ndarray, order: int) -> np.ndarray:
        """log2 of the probability of the last symbol of each key of ``order`` symbols."""
        if order == 0:
            return np.full(len(keys), -float(BITS), np.float32)
        at, hit = find(self.keys[order - 1], keys)
        out = self.logs[order - 1][at]
        if not hit.all():
            miss = keys[~hit]
            place, known = find(self.contexts[order - 1], miss >> BITS)
            left = np.where(known, self.weights[order - 1][place], np.float32(0))
            out[~hit] = left + self.log2(miss & (1 << BITS * (order - 1)) - 1, order - 1)
        return out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array that is not empty, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def discounts(n: np.ndarray, modified: bool) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from counts of counts."""
    n1, n2, n3, n4 = (np.count_nonzero(n == k) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    if not modified or not n3 or not n4:
        return np.array([0, y, y, y])
    many = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(d, 0.1), k + 0.9) for k, d in enumerate(many))])


def fit_all(grams: DataFrame, modified: bool) -> dict[str, KneserNey]:
    """A model for each language of a table of counts; see the module for its size bound."""
    table = grams.toArrow()
    langs = np.array(table["lang"].to_pylist(), dtype=object)
    keys, counts = table["gram"].to_numpy(), table["n"].to_numpy()
    models = {}
    for lang in sorted(set(langs)):
        own = langs == lang
        order = np.argsort(keys[own])
        models[lang] = KneserNey.fit(keys[own][order], counts[own][order], modified)
    return models
