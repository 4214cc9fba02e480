"""Aligning the tokens of two tokenizers over the same bytes.

Both tokenizers cut space + text into tokens that cover its bytes. The character spans of the one
and the spans of the other are coarse cuts; where a token's span does not hold as many bytes as the
token itself (a character split among tokens, byte fallback), the decoded bytes of the tokens give the cuts.
Bytes at which tokens of both end divide them into groups; two tokens that share a byte are linked.

Texts are aligned by segments: byte-level BPE splits a text into runs of letters, digits or signs
with a blank in front, and the other BPE cannot merge over a place if none of its pieces holds the
two signs beside it in that order, which is read from its vocabulary. Both cut at the ends of a
segment, so groups, links and their numbers are those of the segments together.

An id pair's count is the number of documents that hold it linked. Counts stay a table; at most
``BLOCK`` pairs at a time, a range of first ids, are broadcast to be looked up by all documents.

Defined cases. A null or empty text, and one whose tokens on either side do not spell space + text
(as where a text holds the sign that stands for a blank), has no tokens: all its numbers are 0 and its
digest is empty. Names of special tokens inside a text are plain text. Repeated rows are documents
of their own and are all counted; ids may be null. An empty table gives an empty table. Texts are
used whole at any length. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadycast.llm.common import store
from steadycast.llm.segments import Remembered, distinct, joined, slices, spread

BLOCK = 1 << 22
SLICE_BYTES = 3 << 20
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_BLANK = "▁"
_made: dict = {}


def refined(spans: list[tuple[int, int]], tokens: list[bytes]) -> list[int]:
    """The byte at which each token ends. A span is kept if it goes on where the last token ended and is as long as its token."""
    ends, at = [], 0
    for (first, last), token in zip(spans, tokens):
        n = len(token)
        at = last if first == at and last - first == n else at + n
        ends.append(at)
    return ends


def grouped(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> tuple[int, list[tuple[int, int]], str]:
    """The number of groups, linked id pairs in order, and ``a1,a2|b1`` for each group, joined by ``;``."""
    links, groups = [], []
    i = j = first_i = first_j = 0
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        if x <= y:
            i += 1
        if y <= x:
            j += 1
        if x == y:
            groups.append(f"{','.join(map(str, a[first_i:i]))}|{','.join(map(str, b[first_j:j]))}")
            first_i, first_j = i, j
    return len(groups), links, ";".join(groups)


def byte_of() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: visible signs stand for themselves, others count on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Two tokenizers and what is remembered of segments, in one process."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = byte_of()
        names = self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(map(signs.__getitem__, name)) if all(c in signs for c in name) else name.encode()
        self.bytes_b, beside = [], np.zeros((128, 128), bool)
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[1:-1], 16)]))
                continue
            self.bytes_b.append(piece.replace(_BLANK, " ").encode())
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                # A sign beyond ASCII stands for all of them; such pieces only forbid cuts beside blanks.
                near = [32 if c == _BLANK else min(ord(c), 127) for c in piece]
                beside[near[:-1], near[1:]] = True
        if len(self.bytes_b) > 1 << 15 or len(self.bytes_a) > 1 << 17:
            raise ValueError("an id pair has 32 bits: 17 for the first vocabulary, 15 for the second")
        kind = np.zeros(256, np.uint8)
        kind[33:127] = 3
        kind[48:58] = 2
        kind[65:91] = kind[97:123] = 1
        kind[39] = 0
        self.kind = kind
        self.may = ~beside & (kind[:128, None] != kind[None, :128]) & (kind[:128, None] > 0) & (kind[None, :128] > 0)
        self.before_blank = not beside[:, 32][np.arange(128) != 32].any()
        self.lead = [next((chr(x) for x in (97, 44, 48) if self.may[x, y]), None) for y in range(128)]
        self.solid = np.zeros(256, bool)
        self.solid[33:127] = True
        self.known = Remembered(self.align, limit=250_000)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places at which both tokenizers cut whatever else the text holds."""
        here, before = data, np.append(np.uint8(10), data[:-1])
        cut = self.may[np.minimum(before, 127), np.minimum(here, 127)] & (before < 127) & (here < 127)
        if self.before_blank:
            # Letters of two bytes: the first one is 0xC3 to 0xDF.
            wide = (data >= 0xC3) & (data <= 0xDF)
            solid_next = np.append((self.solid[data] | wide)[1:], False)
            solid_last = np.append(False, (self.solid[data] | np.append(False, wide[:-1]))[:-1])
            cut |= (here == 32) & solid_next & solid_last
        return np.flatnonzero(cut)

    def align(self, segments: list[bytes]) -> Iterator[tuple]:
        """For each segment: numbers of tokens, groups and links, linked pairs and groups as bytes; no tokens if they don't spell it."""
        if not segments:
            return
        texts = [s.decode() for s in segments]
        leads = ["" if t[0] == " " else self.lead[ord(t[0])] for t in texts]
        left = self.a.encode_batch(texts, add_special_tokens=False)
        right = self.b.encode([lead + t if lead else t[1:] for t, lead in zip(texts, leads)], return_type="proto", num_threads=1)
        for data, text, lead, enc, proto in zip(segments, texts, leads, left, right):
            a, spans = enc.ids, enc.offsets
            bytes_a = [self.bytes_a[i] for i in a]
            pieces = [(p.id, p.begin, p.end) for p in proto.pieces]
            b = [p[0] for p in pieces]
            bytes_b = [self.bytes_b[i] for i in b]
            spelt = data
            if lead:
                spelt = b" " + lead.encode() + data
            if b"".join(bytes_a) != data or b"".join(bytes_b) != spelt:
                yield -1, 0, 0, 0, b"", b""
                continue
            ends_a = refined(spans, bytes_a)
            # Spans count from behind the blank that is added; the first token holds it.
            ends_b = refined([(x and x + 1, y + 1) for _, x, y in pieces], bytes_b)
            if lead:
                skip = next(k for k, e in enumerate(ends_b) if e == 2) + 1
                b, ends_b = b[skip:], [e - 2 for e in ends_b[skip:]]
            n, links, groups = grouped(a, ends_a, b, ends_b)
            keys = np.array([x << 15 | y for x, y in links], np.uint32)
            yield len(a), len(b), n, len(links), keys.tobytes(), groups.encode()

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Alignment of every text of a batch of (doc_id, text)."""
        texts = batch.column(1)
        n = len(texts)
        data, firsts = joined(texts, b" ")
        full = np.diff(firsts) > 2
        cuts = self.cuts(data)
        row = np.searchsorted(firsts, cuts, "right") - 1
        cuts = cuts[(cuts > firsts[row]) & (cuts < firsts[row + 1] - 1)]
        starts = np.sort(np.concatenate([firsts[:-1][full], cuts]))
        row = np.searchsorted(firsts, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(data)), firsts[row + 1] - 1)
        codes, found = distinct(data, starts, ends)
        values = self.known.of(found)
        bad = np.array([v[0] < 0 for v in values], bool)[codes]
        good = full.copy()
        good[row[bad]] = False
        upto = np.searchsorted(row, np.arange(n + 1))
        out = []
        for k in range(4):
            own = np.array([v[k] for v in values], np.int64)[codes]
            total = np.append(0, own.cumsum())
            out.append(np.where(good, total[upto[1:]] - total[upto[:-1]], 0))
        texts_of = [v[5] for v in values]
        digests = []
        for i in range(n):
            joint = b";".join([texts_of[c] for c in codes[upto[i] : upto[i + 1]].tolist()]) if good[i] else None
            digests.append("" if joint is None else hashlib.sha256(joint).hexdigest())
        sizes = np.fromiter((len(v[4]) >> 2 for v in values), np.int64, len(values))
        flat = np.frombuffer(b"".join([v[4] for v in values]), np.uint32)
        ok = good[row]
        counts = sizes[codes[ok]]
        keys = flat[spread(counts, (sizes.cumsum() - sizes)[codes[ok]])].astype(np.int64)
        keys |= np.repeat(row[ok].astype(np.int64), counts) << 32
        keys, times = np.unique(keys, return_counts=True)
        at = np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << 32).tolist()
        keys, times = keys.astype(np.uint32), times.astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, out), pa.array(digests, pa.string()),
             pa.array([keys[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary()),
             pa.array([times[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())],
            names=[c.split()[0] for c in ROWS.split(", ")],
        )


def aligner(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Pair(path_a, path_b)
    return _made[path_a, path_b]


def tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every document's alignment: numbers, digest, its distinct linked pairs (a << 15 | b, ascending) and how often each is linked."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = aligner(path_a, path_b)
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                yield pair.rows(some)

    return texts.mapInArrow(work, ROWS)


def _numbers(cells: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint32)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How many documents hold each pair, and whether that is the most of its first id: (pair, n, best)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(_numbers(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    counts = store(aligned.select("pairs").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", 15)
    # One row for each id of the first tokenizer: bounded by its vocabulary.
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", first).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _blocks(counts: DataFrame, block: int) -> list[Column]:
    """Conditions that cut the pairs into ranges of first ids with about ``block`` pairs; a range of one id may have more, up to 2^15."""
    sizes = counts.groupBy(F.shiftright("pair", 15).alias("a")).count().orderBy("a").collect()
    bounds, held = [], 0
    for r in sizes:
        if held and held + r["count"] > block:
            bounds.append(r.a)
            held = 0
        held += r["count"]
    lows = [0, *bounds]
    return [F.col("pair").between(x << 15, (y << 15) - 1) for x, y in zip(lows, [*bounds, 1 << 40])]


def align(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    The documents' pairs are stored once; each block of counts is one more step over them.
    """
    spark = docs.sparkSession
    aligned = store(tokens(docs, path_a, path_b), "aligned")
    counts = store(pair_counts(aligned), "pair-scores")
    rows = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    blocks = _blocks(counts, block)
    for k, own in enumerate(blocks):
        table = counts.where(own).toArrow()
        pairs, n = table["pair"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(pairs)
        sent = spark.sparkContext.broadcast((pairs[order].astype(np.uint32), n[order], table["best"].to_numpy()[order]))
        rows = rows.mapInArrow(_look_up(sent), rows.schema)
        if k % 4 == 3 and k + 1 < len(blocks):
            rows = store(rows, "aligned")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _look_up(sent):
    """Add what one block of counts gives to n_best and count_sum."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            keys, times = _numbers(batch.column("pairs")), _numbers(batch.column("times")).astype(np.int64)
            sizes = np.array([len(x) >> 2 for x in batch.column("pairs").to_pylist()], np.int64)
            at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
            times[pairs[at] != keys] = 0
            upto = np.append(0, sizes.cumsum())
            columns = {name: batch.column(name) for name in batch.schema.names}
            for name, own in (("n_best", times * best[at]), ("count_sum", times * n[at])):
                total = np.append(0, own.cumsum())
                columns[name] = pa.array(columns[name].to_numpy() + total[upto[1:]] - total[upto[:-1]])
            yield pa.RecordBatch.from_pydict(columns)

    return work
