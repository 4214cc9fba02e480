"""Texts of a batch as one array of bytes, cut into segments that are looked up once each.

A public tokenizer cuts a text at certain places whatever stands around them, so that a text's
tokens are the tokens of its segments on end; words come back often, too. Segments of a slice are
told apart by a 64-bit hash, computed for all places at once, and only distinct ones are turned into
objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE_BYTES = 4 << 20
GAP = 10
"""The byte put between two texts; it lies in no segment."""


class _Powers:
    """Powers of a random odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed).integers(0, 2**64, 257, np.uint64)
        self.table = draw[:256].copy()
        self.base = np.array([draw[256] | np.uint64(5)])
        inverse = self.base.copy()
        for _ in range(6):
            inverse *= np.uint64(2) - self.base * inverse
        self.inverse = inverse
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            self.up = np.concatenate([self.up, self.up * self.up[-1] * self.base])
            self.down = np.concatenate([self.down, self.down * self.down[-1] * self.inverse])


_POWERS: dict[int, _Powers] = {}
WINDOW = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 20261) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for all spans, which must be in order and apart.

    A polynomial modulo 2^64 over random values of the bytes, of all places at once, in windows of
    about a million bytes. Two different spans agree with a chance near 2^-64.
    """
    powers = _POWERS.setdefault(seed, _Powers(seed))
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + WINDOW, "right")))
        low, high = starts[i], ends[j - 1]
        powers.reach(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(powers.table[data[low:high]] * powers.up[: high - low], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * powers.down[starts[i:j] - low]
        i = j
    return out ^ (ends - starts).astype(np.uint64) << np.uint64(56)


class Remembered:
    """Values of segments, kept in two bounded generations: what was not asked for during one goes."""

    def __init__(self, compute: Callable[[list[bytes]], Iterable], limit: int = 400_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def of(self, segments: list[bytes]) -> list:
        """The value of each segment. Those given should be distinct."""
        values = list(map(self.young.get, segments))
        lacking = [i for i, v in enumerate(values) if v is None]
        if lacking:
            missing = []
            for i in lacking:
                values[i] = self.old.get(segments[i])
                if values[i] is None:
                    missing.append(i)
            for i, v in zip(missing, self.compute([segments[i] for i in missing])):
                values[i] = v
            if len(self.young) + len(lacking) > self.limit:
                self.old, self.young = self.young, {}
            self.young.update((segments[i], values[i]) for i in lacking if len(segments[i]) <= self.longest)
        return values


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    ends = offsets(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def offsets(texts: pa.Array) -> np.ndarray:
    """Where each text of an Arrow string array starts in its buffer, and the last one's end."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def joined(texts: pa.Array, before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All texts (null: empty) with ``before`` and a gap byte around each: bytes, and the first byte of each text.

    Text i lies at ``firsts[i]`` to ``firsts[i + 1] - 1``.
    """
    n, at = len(texts), offsets(texts)
    values = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if n else np.zeros(0, np.uint8)
    extra = len(before) + 1
    firsts = at - (at[0] if n else 0) + np.arange(n + 1) * extra
    data = np.empty(int(firsts[-1]), np.uint8)
    sizes = at[1:] - at[:-1]
    data[np.arange(len(values)) + np.repeat(np.arange(n) * extra + len(before), sizes)] = values
    for k, b in enumerate(before):
        data[firsts[:-1] + k] = b
    data[firsts[1:] - 1] = GAP
    return data, firsts


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each hash in order of appearance, and where each number appears first."""
    codes, _ = pd.factorize(hashes)
    first = np.empty(codes.max() + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def contents(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each span's content, and the contents."""
    codes, first = numbered(span_hashes(data, starts, ends))
    return codes, contents(data, starts[first], ends[first])


def spread(counts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places ``firsts[i], firsts[i] + 1, ...``, ``counts[i]`` of them, for all i on end."""
    ends = counts.cumsum()
    return np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
