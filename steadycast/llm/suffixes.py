"""Removal of repeated byte strings by suffix sorting with a difference cover.

Distribution. Every ``LENGTH``-byte string has an anchor: the ``GRAM``-byte string of least hash
in it, the leftmost one on ties. Equal strings have equal anchors at equal offsets, so strings
can be dealt out by anchor. Copies of an earlier text go as a whole and take no further part. Anchors
cross one shuffle, in order; an anchor found once only cannot lie in a repeated string and is
left out. Around each other anchor, the stretch of text with all strings that belong to it is sent to
the anchor's part. Texts are shuffled once, by id and digest, for both the stretches and the cut.

Sorting. A part sorts the suffixes of its stretches with a difference cover modulo 3: the
sampled triples are sorted, the text of their names is sorted by the same method, the remaining
suffixes are merged in, and adjacent prefixes are compared. Recursion ends when names span
``LENGTH`` bytes, as deeper order is not needed. Of equal strings all but the earliest are
repeats. Bytes are compared, so hashes only steer the work.

Hot anchors. Equal stretches are combined before the shuffle. The stretches of an anchor with more than
``hot`` rows are dealt out in at most ``SPAN / STEP`` pieces, by the bytes that all ``STEP`` strings of a piece have in
common; equal strings have their anchor at the same offset, so they lie in pieces of one part. Only where a part still gets
more than ``hot`` pieces are its strings dealt out one by one, by their own hashes, so that no task has to hold them all.

Defined cases. A null text is empty; nothing shorter than ``LENGTH`` bytes is ever removed.
Null ids come first. Repeated rows (same id, same text) are one document, and each row gets its
result; rows of one id with different texts are ordered by a hash of the text. An empty table
gives an empty table. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.llm.common import mix64, nullable, store, utf8

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # grams in a string
SIDE = -(-(LENGTH - GRAM) // 2)  # a string reaches this far from its anchor on one side at least
LEAST_ID = -(2**63)
PLACE_BITS = 24
SLAB = 1 << 21
STEP = 9  # strings in a piece of a hot anchor's stretch


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    four = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(b) - GRAM + 1
    x = eight[:n]
    for k in range(8, GRAM, 8):
        x = mix64(x) + eight[k : n + k] * np.uint64(0x9E3779B97F4A7C15)
    return mix64(x)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of a text: hash, first and last start of the strings it belongs to, place."""
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 4
    hashes, firsts, lasts, places = [], [], [], []
    step = (1 << PLACE_BITS) - LENGTH  # very long texts go by stretches that share no string
    for begin in range(0, len(data) - LENGTH + 1, step):
        piece = data[begin : begin + step + LENGTH - 1]
        h = mix64(gram_hashes(piece))
        place = np.arange(len(h), dtype=np.uint64)
        least = sliding_least(h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | place, SPAN)
        at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        change = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        hashes.append(h[at[change]].view(np.int64))
        firsts.append(begin + change)
        lasts.append(begin + np.append(change[1:], len(at)) - 1)
        places.append(begin + at[change])
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts), np.concatenate(places)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of values, equal ones alike."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.append(False, s[1:] != s[:-1])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum()) + 1


def suffix_ranks(s: np.ndarray, spans: int = 1) -> np.ndarray:
    """Ranks of all suffixes by their first ``LENGTH`` bytes at least, by a difference cover mod 3.

    ``s`` holds values below 2^21, each of which stands for ``spans`` bytes; suffixes that are
    alike over three times the depth needed may share a rank.
    """
    n = len(s)
    t = np.append(s + 1, np.zeros(6, np.int64))  # ends sort first
    place = np.arange(n + 1)  # one suffix past the end keeps the neighbours of the last defined
    sample = place[place % 3 != 0]
    triple = t[sample] << 42 | t[sample + 1] << 21 | t[sample + 2]
    name, kinds = _ranks(triple)
    if kinds < len(sample) and 3 * spans < LENGTH:
        one, two = np.flatnonzero(sample % 3 == 1), np.flatnonzero(sample % 3 == 2)
        deeper = suffix_ranks(np.concatenate([name[one], name[two]]), 3 * spans)
        name[one], name[two] = deeper[: len(one)], deeper[len(one) :]
    rank = np.zeros(n + 8, np.int64)
    rank[sample] = name + 1
    # Merge: a suffix of the rest against those at 1 mod 3 by its first value and the rank after
    # it, against those at 2 mod 3 by two values; the samples among themselves by rank.
    rest = place[place % 3 == 0]
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    by_one = lambda i: t[i] << 40 | rank[i + 1]
    by_two = lambda i: (t[i] << 21 | t[i + 1]) * (n + 9) + rank[i + 2]
    rest_one, rest_two = by_one(rest), by_two(rest)
    place_of = np.zeros(n + 1, np.int64)
    # Numbers of lesser suffixes; equal ones get equal numbers.
    less = lambda sorted_keys, keys: np.searchsorted(sorted_keys, keys)
    s_rest, s_one, s_two = np.sort(rest_one), np.sort(by_one(ones)), np.sort(by_two(twos))
    place_of[rest] = less(s_rest, rest_one) + less(s_one, rest_one) + less(s_two, rest_two)
    s_name = np.sort(name)
    place_of[ones] = less(s_name, name[sample % 3 == 1]) + less(s_rest, by_one(ones))
    place_of[twos] = less(s_name, name[sample % 3 == 2]) + less(np.sort(rest_two), by_two(twos))
    return place_of[:n]


def repeats(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Whether the ``LENGTH``-byte string from each start equals one from an earlier start."""
    b = np.frombuffer(text, np.uint8)
    rank = suffix_ranks(b.astype(np.int64))[starts]
    order = np.lexsort((starts, rank))
    at = starts[order]
    padded = np.append(b, np.zeros(8, np.uint8))
    same = np.ones(max(len(at) - 1, 0), bool)
    words = padded[:-7].astype(np.uint64)
    for k in range(1, 8):
        words |= padded[k : len(words) + k].astype(np.uint64) << np.uint64(8 * k)
    for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = words[at + offset]
        same &= w[1:] == w[:-1]
    out = np.zeros(len(starts), bool)
    # In a run of equal strings the first in order need not be the earliest when ranks differ.
    run = np.cumsum(np.append(True, ~same)) if len(at) else np.empty(0, np.int64)
    earliest = np.full(len(at) + 1, len(text), np.int64)
    np.minimum.at(earliest, run, at)
    out[order] = at != earliest[run]
    return out


KEY = ["doc_id", "digest"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id without nulls, text, a digest of it, and ``rest``: all columns but text, so that every
    reader of the texts asks for the same columns and their shuffle is shared."""
    rest = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"), F.struct(*rest).alias("rest"),
    )


ROWS = "anchor long, part long, doc_id long, digest long, first long, last long, at int, stretch binary"
ROWS_ARROW = pa.schema(
    [(n, {"binary": pa.binary(), "int": pa.int32()}.get(t, pa.int64())) for n, t in (f.split() for f in ROWS.split(", "))]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(ROWS_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ROWS_ARROW)], schema=ROWS_ARROW)


FOUND = "hash long, doc_id long, digest long, number int"


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of (doc_id, digest, text) rows, numbered within a text, as ``FOUND``."""
    for batch in batches:
        parts = []
        for doc_id, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            h = anchors(utf8(text.as_py()))[0]
            if len(h):
                parts.append((h, np.full(len(h), doc_id), np.full(len(h), own), np.arange(len(h), dtype=np.int32)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["hash", *KEY, "number"])


def shared_anchors(hot: int):
    """Of ``FOUND`` rows in order of hash, those whose hash lies in two texts or twice in one.

    At most ``hot`` rows and a batch are held: a run of more rows is known to be hot, and is let through.
    """

    def settle(columns: list[np.ndarray], passing: int | None, end: bool) -> tuple[pa.RecordBatch, list[np.ndarray], int | None]:
        key, _, own, number = columns
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        sizes = np.diff(np.append(heads, len(key)))
        first = np.repeat(heads, sizes)
        unlike = (own != own[first]) | (number != number[first])
        wanted = np.logical_or.reduceat(unlike, heads) if len(heads) else np.zeros(0, bool)
        large = sizes > hot
        if len(heads) and passing is not None and key[0] == passing:
            wanted[0] = large[0] = True
        held, passing = [c[:0] for c in columns], None
        if len(heads) and not end:
            if wanted[-1] and large[-1]:
                passing = key[-1]
            else:  # rows that are all alike are one text's, and one of them will do
                held = [c[heads[-1] :] if wanted[-1] or not large[-1] else c[heads[-1] : heads[-1] + 1] for c in columns]
                wanted[-1] = False
        out = np.repeat(wanted, sizes)
        given = [pa.array(c[out]) for c in columns[1:]] + [pa.array(np.repeat(large, sizes)[out])]
        return pa.RecordBatch.from_arrays(given, names=[*KEY, "number", "hot"]), held, passing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            out, held, passing = settle(columns, passing, False)
            yield out
        if held is not None:
            yield settle(held, passing, True)[0]

    return run


def send_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches around the wanted anchors of (doc_id, text, digest, wanted, rest) rows.

    Of stretches that are equal within the task only the earliest is sent; the others are
    given back at once as repeats, without an anchor, those that touch in one text as one.
    """
    held: dict[tuple[int, int, bytes], tuple] = {}
    seen: dict[tuple[int, bytes], tuple] = {}
    rows: list[tuple] = []

    def add(anchor: int, part: int, place: tuple, stretch: bytes, again: list[tuple[int, int]]) -> None:
        old = held.setdefault((anchor, part, stretch), place)
        if place < old:
            held[anchor, part, stretch] = place
            rows.append((None, 0, *old, None))
        elif place != old:
            again.append(place[2:4])

    def flush() -> list[tuple]:
        out = [(a, p, *place, stretch) for (a, p, stretch), place in held.items()]
        held.clear()
        seen.clear()
        return out

    for batch in batches:
        for doc_id, text, own, wanted in zip(*(c.to_pylist() for c in batch.columns[:4])):
            data = utf8(text)
            hashes, firsts, lasts, places = anchors(data)
            again: list[tuple[int, int]] = []
            for w in wanted:
                k = w["number"]
                first, last, at, anchor = int(firsts[k]), int(lasts[k]), int(places[k]), int(hashes[k])
                place, stretch = (doc_id, own, first, last, at - first), data[first : last + LENGTH]
                if not w["hot"]:
                    add(anchor, 0, place, stretch, again)
                    continue
                old = seen.setdefault((anchor, stretch), place)
                if old < place:
                    again.append((first, last))
                    continue
                seen[anchor, stretch] = place
                # A piece has the strings with their anchor at STEP neighbouring offsets; the core is in all of them.
                for step in range((at - last) // STEP, (at - first) // STEP + 1):
                    stop = at - step * STEP
                    core = data[stop : stop - STEP + 1 + LENGTH]
                    low, high = max(first, stop - STEP + 1), min(last, stop)
                    add(anchor, digest(b"%d " % step + core) or 1, (doc_id, own, low, high, at - low), data[low : high + LENGTH], again)
            again.sort()
            touches = [x[0] > y[1] + 1 for y, x in zip(again, again[1:])]
            heads = [0, *(k + 1 for k, apart in enumerate(touches) if apart)] if again else []
            for head, end in zip(heads, [*heads[1:], len(again)]):
                rows.append((None, 0, doc_id, own, again[head][0], again[end - 1][1], None, None))
            if len(held) + len(seen) > 100_000:
                rows += flush()
        yield _batch(rows)
        rows.clear()
    yield _batch(flush())


def sort_stretches(hot: int | None):
    """Repeats among stretches that come in order of anchor and part; what has no anchor passes.

    With ``hot``, the strings of a part with more pieces of a hot anchor are given back one by one, to be dealt out anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab: list[tuple] = []
        size, last_key, begun, large = 0, None, 0, False

        def solve() -> list[tuple]:
            earliest: dict[tuple, tuple] = {}
            sides: dict[tuple, int] = {}
            out, kept = [], []
            for doc_id, own, first, last, at, key, stretch in sorted(slab):
                place = (doc_id, own, first)
                if earliest.setdefault((key, stretch), place) != place:
                    out.append((None, 0, doc_id, own, first, last, None, None))
                    continue
                left = (key, 0, stretch[at - SIDE : at + GRAM]) if at >= SIDE else None
                right = (key, 1, stretch[at : at + GRAM + SIDE]) if at + GRAM + SIDE <= len(stretch) else None
                for side in (left, right):
                    sides[side] = sides.get(side, 0) + 1
                kept.append((doc_id, own, first, last, stretch, left, right))
            # Equal strings agree on one side of their anchor at least. The strings of one stretch
            # differ, as each has the anchor at another place.
            sides[None] = 0
            kept = [k for k in kept if sides[k[5]] > 1 or sides[k[6]] > 1]
            if not kept:
                return out
            text = b"".join(k[4] for k in kept)
            lengths = np.array([len(k[4]) for k in kept])
            counts = lengths - LENGTH + 1
            begins = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(kept)), counts)
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            again = np.flatnonzero(repeats(text, begins[owner] + inner))
            if len(again):
                gap = np.append(True, (np.diff(again) > 1) | (np.diff(owner[again]) > 0))
                heads = np.flatnonzero(gap)
                tails = np.append(heads[1:], len(again)) - 1
                for a, b in zip(again[heads], again[tails]):
                    doc_id, own, first = kept[owner[a]][:3]
                    out.append((None, 0, doc_id, own, int(first + inner[a]), int(first + inner[b]), None, None))
            return out

        def strings(doc_id: int, own: int, first: int, last: int, at: int, key: tuple[int, int], stretch: bytes) -> Iterator[tuple]:
            for k in range(last - first + 1):
                string = stretch[k : k + LENGTH]
                yield key[0], digest(string) or 1, doc_id, own, first + k, first + k, at - k, string

        for batch in batches:
            done: list[tuple] = []
            for anchor, part, doc_id, own, first, last, at, stretch in zip(*(c.to_pylist() for c in batch.columns)):
                if stretch is None:
                    done.append((None, 0, doc_id, own, first, last, None, None))
                    continue
                if (anchor, part) != last_key:
                    # A slab is closed between anchors, or between the parts of one.
                    if size >= SLAB // 2:
                        done += solve()
                        slab, size = [], 0
                    last_key, begun, large = (anchor, part), len(slab), False
                slab.append((doc_id, own, first, last, at, last_key, stretch))
                size += len(stretch)
                large = large or bool(hot and part and len(slab) - begun > hot)
                if large:
                    for row in slab[begun:]:
                        done += strings(*row)
                        size -= len(row[6])
                    del slab[begun:]
            yield _batch(done)
        if slab:
            yield _batch(solve())

    return run


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of the texts that copy one of a lesser id. ``docs`` is ``_keyed``."""
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("sha")
    firsts = docs.groupBy(sha).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last")
    return docs.select(*KEY, sha).join(firsts, "sha").where("doc_id > least").select(*KEY).distinct()


def repeated(docs: DataFrame, copied: DataFrame, hot: int = 8000) -> DataFrame:
    """Starts of repeated strings: (doc_id, digest, ranges) with ranges of first and last starts.

    ``docs`` is ``_keyed``. Texts in ``copied`` are left out: what repeats one of their strings
    repeats the earlier text, too.
    """
    fresh = docs.join(copied, KEY, "left_anti").select(*KEY, "text")
    found = fresh.mapInArrow(find_anchors, FOUND).repartition("hash").sortWithinPartitions("hash")
    wanted = found.mapInArrow(shared_anchors(hot), "doc_id long, digest long, number int, hot boolean")
    wanted = wanted.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("number", "hot"))).alias("wanted"))
    sent = docs.join(wanted, KEY).select("doc_id", "text", "digest", "wanted", "rest").mapInArrow(send_stretches, ROWS)
    ranges = sent
    for most in (hot, None):
        # What is settled already has no anchor; it is spread by its document.
        dealt = ranges.repartition(F.coalesce("anchor", F.xxhash64("doc_id", "first")), "part").sortWithinPartitions("anchor", "part")
        ranges = dealt.mapInArrow(sort_stretches(most), ROWS)
    return ranges.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def _cut(data: bytes, ranges: list[dict] | None, copy: bool) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes removed, and of runs of them."""
    if len(data) < LENGTH:
        return data, 0, 0
    if copy:
        return b"", len(data), 1
    if not ranges:
        return data, 0, 0
    spans = sorted((r["first"], r["last"] + LENGTH) for r in ranges)
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for first, stop in spans:
        if first > end:  # runs that touch are one
            runs += 1
            kept.append(data[max(at, 0) : first])
            removed += stop - first
            at = end = stop
        elif stop > end:
            removed += stop - end
            at = end = stop
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def noted(docs: DataFrame) -> DataFrame:
    """``docs``, which is ``_keyed``, with ``ranges`` of repeated strings and ``copied``, true for texts that copy an earlier one."""
    copied = store(copies(docs), "copies")
    out = docs.join(repeated(docs, copied), KEY, "left").join(copied.withColumn("copied", F.lit(True)), KEY, "left")
    return out.select("doc_id", "text", "digest", "rest", "ranges", "copied")


def remove(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row; kept: the bytes left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, ranges, copied in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges", "copied"))):
                data = utf8(text)
                kept, removed, runs = _cut(data, ranges, bool(copied))
                rows.append((None if doc_id == LEAST_ID else doc_id, len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return noted(_keyed(docs.select("doc_id", "text"))).mapInArrow(run, schema)


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with only the bytes left in ``text``.

    Where a cut leaves part of a character, the part goes too. ``n_chars``, if there, is counted
    anew. A row whose text is cut to nothing is left out.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], []
            for text, ranges, copied in zip(*(batch.column(c).to_pylist() for c in ("text", "ranges", "copied"))):
                kept, removed, _ = _cut(utf8(text), ranges, bool(copied))
                texts.append(kept.decode("utf-8", "ignore") if removed else text)
                stay.append(not removed or bool(texts[-1].strip()))
            fields = dict(zip(batch.column("rest").type.names, batch.column("rest").flatten()))
            columns = [pa.array(texts, pa.string()) if c == "text" else fields[c] for c in names]
            if "n_chars" in names:
                at = names.index("n_chars")
                size = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                columns[at] = size.cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))

    return noted(_keyed(docs)).mapInArrow(run, nullable(docs))
