"""Token ids in ORC files: ordered by document, split by stripes, pruned by their statistics.

One row is a document: its id, its place among the tokens of its file, how many it has, and the
ids. ORC keeps integers run-length encoded; row indexes hold least and greatest values of every
few thousand rows, and Bloom filters tell which document ids a stretch of rows cannot hold. So a
reader takes stripes in parallel, and a look-up by document or by token place reads only what may
match. A small table beside the files lists each file's range of ids and of tokens.

Rows are dealt out by ranges of (doc_id, hash of the text), so that many rows of one id, nulls
above all, are spread; then sorted, encoded and written in one pass. No row is held back: what a
document starts at is counted inside its file, and the list of files gives where a file starts.

Defined cases. A null text is an empty one; its row holds the end id only. Null ids come before
all others; rows of equal id are ordered by the hash of their text and by the text, and equal rows are all kept. An empty
table gives files without rows. Columns beside ``doc_id`` and ``text`` are not read. A text is
encoded whole, at any length. Ids must lie below 2^31.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadycast.llm.segments import GAP, Remembered, distinct, joined, slices, spread
from steadycast.session import run_dir

END_ID = 1
ROWS = "doc_id long, place long, n_tokens long, ids array<int>"
FILES = "file string, first_id long, last_id long, nulls long, n_docs long, n_tokens long, start long"
SLICE_BYTES = 8 << 20
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 2000

_made: dict = {}


def word_bpe(path: str) -> Callable:
    """A factory of an encoder of string arrays by a lower-casing BPE whose words never span white space.

    Its pattern takes runs of letters, single digits and runs of signs, apart from apostrophes with
    letters behind them, and it drops white space. So texts are cut at white space in ASCII, and
    between two bytes of ASCII, neither of them an apostrophe, of which one is a letter. Letters in front of
    another byte of ASCII are lower-cased first. A text with the name of a special token in it is not cut.
    """

    def make():
        if path not in _made:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            kind = np.full(256, 2, np.uint8)
            kind[[9, 10, 11, 12, 13, 32]] = 0
            letters = np.arange(65, 91)
            kind[letters] = kind[letters + 32] = 1
            kind[[28, 29, 30, 31, 39]] = kind[128:] = 3
            lower = np.arange(256, dtype=np.uint8)
            lower[letters] += 32

            def values(words: list[bytes]) -> Iterator[np.ndarray]:
                texts = [w.decode() for w in words]
                simple = [t.isascii() and t.islower() and t.isalpha() for t in texts]
                others = [t for t, plain in zip(texts, simple) if not plain]
                rest = iter(tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else ())
                for t, plain in zip(texts, simple):
                    # Small ASCII letters are one word as they stand: the model alone splits them.
                    ids = [x.id for x in tokenizer.model.tokenize(t)] if plain else next(rest).ids
                    yield array("I", ids).tobytes()

            known = Remembered(values)

            def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
                data, firsts = joined(texts)
                kinds = kind[data]
                if any(pc.any(pc.match_substring(texts, name)).as_py() for name in names):
                    whole = [t is not None and any(name in t for name in names) for t in texts.to_pylist()]
                    within = np.repeat(whole, np.diff(firsts))
                    kinds[within] = 3
                else:
                    within = False
                data = np.where(within | (np.append(data[1:], np.uint8(GAP)) > 127), data, lower[data])
                kinds[firsts[1:] - 1] = 0
                none = np.zeros(1, np.uint8)
                before, after = np.append(none, kinds[:-1]), np.append(kinds[1:], none)
                starts = np.flatnonzero((kinds > 0) & (before != kinds) & ((before == 0) | ((before < 3) & (kinds < 3))))
                ends = np.flatnonzero((kinds > 0) & (after != kinds) & ((after == 0) | ((after < 3) & (kinds < 3)))) + 1
                codes, words = distinct(data, starts, ends)
                ids = known.of(words)
                lengths = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
                flat = np.frombuffer(b"".join(ids), "<u4")
                counts = lengths[codes]
                tokens = flat[spread(counts, (lengths.cumsum() - lengths)[codes])]
                upto = np.append(0, counts.cumsum())
                return tokens, upto[np.searchsorted(starts, firsts)]

            _made[path] = encode
        return _made[path]

    return make


def write(docs: DataFrame, path: str, encoder: Callable, end_id: int | None = END_ID, parts: int | None = None,
          stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files below ``path``, in ascending order of ids.

    ``encoder`` makes, in a task, a function of an Arrow array of texts to all their ids on end and
    to the place of each text's first id, with the end behind. ``end_id`` ends each document (None:
    nothing is added).
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "tie")
    rows = rows.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text").drop("tie")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = encoder(), 0
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                tokens, upto = encode(some.column(1))
                if end_id is not None:
                    tokens = np.insert(tokens, upto[1:], end_id)
                    upto = upto + np.arange(len(upto))
                ends, counts = upto[1:], np.diff(upto)
                values = pa.array(tokens.astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(place + ends - counts), pa.array(counts), lists],
                    names=["doc_id", "place", "n_tokens", "ids"],
                )
                place += int(ends[-1])

    options = {
        "compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }
    rows.mapInArrow(work, ROWS).write.options(**options).orc(f"{path}/rows")
    listed = _rows(spark, path).groupBy("file").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_if(F.isnull("doc_id")).alias("nulls"),
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
    )
    # One row a file, in one group: as many rows as the driver holds to list the files for a scan.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    listed.select(FILES.replace(" long", "").replace(" string", "").split(", ")).write.orc(f"{path}/files")


def _rows(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    where = [f"{path}/rows"] if files is None else [f"{path}/rows/{f}" for f in files]
    return spark.read.schema(ROWS).orc(where).select("*", F.col("_metadata.file_name").alias("file"))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: range of ids, rows of null id, documents, tokens, and the tokens of the files before."""
    return spark.read.schema(FILES).orc(f"{path}/files")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents: doc_id, start (tokens of all documents before), n_tokens, ids. Stripes are read in parallel."""
    return _placed(_rows(spark, path), spark, path)


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    starts = file_list(spark, path).select("file", F.col("start").alias("before"))
    rows = rows.join(F.broadcast(starts), "file")
    return rows.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def look_up(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of the given documents. Files are chosen by their range of ids, stripes and rows by index and Bloom filter."""
    wanted = F.array(*(F.lit(i).cast("long") for i in ids))
    files = file_list(spark, path).where(F.exists(wanted, lambda i: i.between(F.col("first_id"), F.col("last_id"))))
    rows = _rows(spark, path, [r.file for r in files.select("file").collect()]) if ids else _rows(spark, path)
    return _placed(rows.where(F.col("doc_id").isin(ids)), spark, path)


def token_range(spark: SparkSession, path: str, first: int, n: int) -> DataFrame:
    """Documents that hold tokens ``first`` to ``first + n`` of all, cut to them: doc_id, start (of the cut), n_tokens, ids."""
    files = file_list(spark, path).where(F.expr(f"start < {first + n} AND start + n_tokens > {first}")).collect()
    parts = [
        _rows(spark, path, [f.file])
        .where((F.col("place") < first + n - f.start) & (F.col("place") > first - f.start - f.n_tokens))
        .where(F.col("place") + F.col("n_tokens") > first - f.start)
        for f in (files[:1] + files[1:][-1:])
    ]
    inner = [f.file for f in files[1:-1]]
    if inner:
        parts.append(_rows(spark, path, inner))
    rows = _rows(spark, path).limit(0)
    for p in parts:
        rows = rows.unionByName(p)
    rows = _placed(rows, spark, path)
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    end = F.least(F.lit(first + n) - F.col("start"), F.col("n_tokens"))
    return rows.select(
        "doc_id", (F.col("start") + skip).alias("start"), (end - skip).alias("n_tokens"),
        F.slice("ids", (skip + 1).cast("int"), (end - skip).cast("int")).alias("ids"),
    )


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path_of_vocabulary: str) -> DataFrame:
    """Write ``docs`` to a new folder of the shared place and give the digest of every document read back."""
    path = run_dir(docs.sparkSession, "llm-orc")
    write(docs, path, word_bpe(path_of_vocabulary))
    return checksums(read(docs.sparkSession, path))
