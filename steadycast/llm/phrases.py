"""Fingerprints from Lempel-Ziv phrases, and likeness of neighbouring documents.

A text is parsed into dictionary phrases (each the longest known phrase and one byte more), the
phrases are hashed, and the smallest hashes of the set are its signature. The share of common
hashes among the smallest of two signatures estimates the Jaccard index of the phrase sets,
which follows how well one text would compress given the other.

Defined cases. A null text is an empty one. An empty text has an empty fingerprint; two empty
ones are alike (1.0), an empty one and another are not (0.0). Null ids sort after all others in
descending order; rows with equal ids are ordered by text. A document that is alone is its own
next one. An empty table gives an empty table. A text is held whole in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.llm.common import mix64, utf8

SIGNATURE = 128


def parse(data: bytes, known: set[bytes]) -> tuple[list[bytes], bytes]:
    """New phrases of ``data`` given the known ones, which grow, and the rest that is no new phrase."""
    new, start = [], 0
    for end in range(1, len(data) + 1):
        phrase = data[start:end]
        if phrase not in known:
            known.add(phrase)
            new.append(phrase)
            start = end
    return new, data[start:]


def hashes(phrases: list[bytes]) -> np.ndarray:
    codes = np.fromiter(map(zlib.crc32, phrases), np.uint64, len(phrases))
    sizes = np.fromiter(map(len, phrases), np.uint64, len(phrases))
    return (mix64(codes | sizes << np.uint64(32)) >> np.uint64(32)).astype(np.uint32)


def signature(*parts: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:SIGNATURE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:SIGNATURE]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(common <= both[-1])) / len(both)


def fingerprint(text: str | None) -> np.ndarray:
    return signature(hashes(parse(utf8(text), set())[0]))


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Doc:
    """A document with its parse; the phrases of its unedited head are kept for the edited text."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        half = len(text) // 2
        self.known: set[bytes] = set()
        head, rest = parse(utf8(text[: len(text) - half]), self.known)
        self.rest = rest
        self.head = hashes(head)
        tail, _ = parse(rest + utf8(text[len(text) - half :]), self.known)
        self.known.difference_update(tail)
        self.sig = signature(self.head, hashes(tail))

    def row(self, following: _Doc) -> tuple:
        edited = edit(self.text, following.text)
        half = len(self.text) // 2
        new, _ = parse(self.rest + utf8(following.text[:half]), self.known)
        sig = signature(self.head, hashes(new))
        return (
            self.doc_id, len(self.text), hashlib.sha256(utf8(edited)).hexdigest(), hexed(self.sig), hexed(sig),
            likeness(self.sig, sig), likeness(self.sig, following.sig),
        )


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
OUT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
LEAST = -(2**63)


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every document and its edited text, in descending order of ids.

    Documents are dealt out by ranges of ids whose bounds are ids themselves, one bound a range.
    The largest document of a range is also sent, as a guest, to the range above, where it is
    the next one of the smallest. So one shuffle of the texts does it.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = texts.select(F.coalesce("doc_id", F.lit(LEAST)).alias("i"))
    tops = ids.repartitionByRange(parts, "i").groupBy(F.spark_partition_id()).agg(F.max("i").alias("top"))
    bounds = np.array(sorted({r.top for r in tops.collect()}) or [0], dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).fill_null(LEAST).to_numpy()
            own = np.searchsorted(bounds, at)
            guests = np.flatnonzero(bounds[own] == at)
            rows = np.concatenate([np.arange(len(at)), guests])
            part = np.concatenate([own, (own[guests] + 1) % len(bounds)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(np.arange(len(rows)) >= len(at)), *(c.take(pa.array(rows)) for c in batch.columns)],
                names=["part", "guest", "doc_id", "text"],
            )

    dealt = texts.mapInArrow(deal, "part int, guest boolean, doc_id long, text string")
    dealt = dealt.repartitionById(len(bounds), "part")
    dealt = dealt.sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Doc | None = None
        rows: list[tuple] = []
        ended = False
        for batch in batches:
            for guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if ended:
                    break
                doc = _Doc(doc_id, text or "")
                if before is not None:
                    rows.append(before.row(doc))
                before, ended = doc, guest
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), OUT_ARROW)], schema=OUT_ARROW)
                rows = []

    return dealt.mapInArrow(work, OUT)
