"""Packing of tokenised documents into fixed windows: bounded-space best fit.

Each partition keeps a fixed number of open windows. A piece goes to the open window it fits
most tightly; when none fits and no more windows may be opened, the fullest is emitted, after
it has been filled with the head of the piece if its gap is worth a cut. The windows left open
at the end of all partitions are merged in rounds of bounded groups by the same rule, and the
last group is poured together, so that one short window remains in all.

Defined cases. A null or empty text is one token, the end mark. Texts of any length are cut
into whole windows as they are read. Repeated rows are packed once each. An empty table gives
an empty table. Null ids are kept.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.llm.common import store

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, part long, open boolean, ids binary"
)
NAMES = [field.split()[0] for field in PIECE.split(", ")]
ARROW = pa.schema(
    [(n, {"boolean": pa.bool_(), "binary": pa.binary()}.get(t, pa.int64())) for n, t in (f.split() for f in PIECE.split(", "))]
)
END_ID = 1


def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    """Encoder of a public byte-level vocabulary.

    The rank file holds the same vocabulary as the JSON file and is read by a faster library.
    Texts that spell out a special token go through the JSON file, which knows them.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    return encode


class Packer:
    """Best fit into a bounded number of open windows; ``rows`` gathers finished pieces."""

    def __init__(self, window: int, open_windows: int, min_cut: int, first_id: int):
        self.window, self.open_windows, self.min_cut, self.next_id = window, open_windows, min_cut, first_id
        self.gaps: list[tuple[int, int]] = []  # sorted (gap, number of the open window)
        self.content: dict[int, list] = {}
        self.rows: list[tuple] = []
        self._number = 0

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def place(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc_id, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect.bisect_left(self.gaps, (len(ids), -1))
            if at == len(self.gaps):  # fits nowhere
                if len(self.gaps) < self.open_windows:
                    at = self._open()
                else:
                    gap, number = self.gaps.pop(0)
                    pieces = self.content.pop(number)
                    if gap >= self.min_cut:
                        pieces.append((doc_id, start, ids[:gap], total))
                        start, ids = start + gap, ids[gap:]
                    self.emit(pieces)
                    continue
            gap, number = self.gaps.pop(at)
            self.content[number].append((doc_id, start, ids, total))
            if gap == len(ids):
                self.emit(self.content.pop(number))
            else:
                bisect.insort(self.gaps, (gap - len(ids), number))
            return

    def _open(self) -> int:
        self._number += 1
        self.content[self._number] = []
        bisect.insort(self.gaps, (self.window, self._number))
        return len(self.gaps) - 1

    def pour(self) -> None:
        """Empty all open windows into full ones and one rest."""
        pieces = [p for _, number in self.gaps for p in self.content[number]]
        self.gaps, self.content = [], {}
        held: list = []
        room = self.window
        for doc_id, start, ids, total in pieces:
            while len(ids):
                head, ids = ids[:room], ids[room:]
                held.append((doc_id, start, head, total))
                start, room = start + len(head), room - len(head)
                if not room:
                    self.emit(held)
                    held, room = [], self.window
        if held:
            self.emit(held)

    def left(self, part: int) -> list[tuple]:
        """Pieces of the windows still open; ``sequence_id`` is the window's number."""
        out = []
        for _, number in self.gaps:
            offset = 0
            for doc_id, start, ids, total in self.content[number]:
                out.append((doc_id, start, len(ids), None, total, number, offset, part, True, ids.tobytes()))
                offset += len(ids)
        return out

    def take(self, part: int) -> list[tuple]:
        rows, self.rows = self.rows, []
        return [(*r, part, False, None) for r in rows]


def _first_id(level: int, part: int) -> int:
    """Room for 2^32 windows in each of 2^24 parts of each level."""
    return level << 56 | part << 32


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ARROW)], schema=ARROW)


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str], np.ndarray]] = byte_bpe,
    window: int = 2048,
    open_windows: int = 64,
    min_cut: int = 16,
    fan_in: int = 32,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): which ids lie where in which sequence.

    A gap below ``min_cut`` tokens is padded instead of cutting a document for it. What is
    left open, at most ``open_windows`` windows a part, is merged ``fan_in`` parts at a time.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, encode = Packer(window, open_windows, min_cut, _first_id(0, part)), encoder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                packer.place(doc_id, 0, ids, len(ids))
            yield _table(packer.take(part))
        yield _table(packer.left(part))

    def merge_level(level: int, last: bool):
        def merge(frame: pd.DataFrame) -> pd.DataFrame:
            part = int(frame["part"].iloc[0]) // fan_in
            packer = Packer(window, open_windows, min_cut, _first_id(level, part))
            for r in frame.sort_values(["length", "part", "sequence_id", "offset"], ascending=[False, True, True, True]).itertuples():
                doc_id = None if pd.isna(r.doc_id) else int(r.doc_id)
                packer.place(doc_id, int(r.start), np.frombuffer(r.ids, dtype="<u4"), int(r.doc_tokens))
            if last:
                packer.pour()
            return _table(packer.take(part) + packer.left(part)).to_pandas()

        return merge

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    stored = store(text.mapInArrow(first, PIECE), "pieces")
    done = [stored.where("not open")]
    parts = stored.agg(F.max("part")).first()[0]
    level = 0
    while parts is not None:
        level, last = level + 1, parts < fan_in
        merged = stored.where("open").groupBy((F.col("part") / fan_in).cast("long")).applyInPandas(merge_level(level, last), PIECE)
        stored = store(merged, f"pieces-{level}")
        done.append(stored.where("not open"))
        parts = None if last else parts // fan_in
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "open", "ids")
