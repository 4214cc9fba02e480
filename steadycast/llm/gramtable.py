"""Character models with modified Kneser-Ney smoothing, as tables that only Spark holds.

A 4-gram key is four UTF-16 units as they are, 64 bits wide: no sign is folded into another, and
a table has as many rows as the corpus has distinct 4-grams. Tables are dealt out by hash of
language and gram; they are never collected or broadcast. What is gathered for a language on
one machine is three discounts an order.

A gram that no counted text has comes with a count of 0, so that every gram which is to be
scored has a row, and a score is looked up by a plain join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadycast.llm import charlm
from steadycast.llm.common import store

ORDER, BITS = 4, 16
GRAMS = "lang string, gram long, n long"


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-gram keys of all texts on end, and how many each text has; a text begins after three spaces."""
    parts, sizes = [], []
    for text in texts:
        s = charlm.units(text)
        parts += [np.full(ORDER - 1, 32, np.uint16), s]
        sizes.append(len(s))
    count = np.array(sizes, np.int64)
    if not count.sum():
        return np.empty(0, np.int64), count
    s = np.concatenate(parts).astype(np.uint64)
    keys = s[:-3] << np.uint64(48) | s[1:-2] << np.uint64(32) | s[2:-1] << np.uint64(16) | s[3:]
    keep = np.ones(len(s), bool)
    begins = np.cumsum(count + ORDER - 1) - (count + ORDER - 1)
    for k in range(ORDER - 1):
        keep[begins + k] = False
    return keys[keep[ORDER - 1 :]].view(np.int64), count


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (lang, text, plain); only plain texts add to ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple[str, bool], list[str]] = {}
            for lang, text, plain in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    by.setdefault((lang, plain), []).append(text)
            for (lang, plain), texts in by.items():
                for a, b in charlm.chunks(texts):
                    grams, n = np.unique(keys_of(texts[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n * plain)],
                        names=["lang", "gram", "n"],
                    )

    return docs.select("lang", "text", "plain").mapInArrow(run, GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _last(gram: Column, order: int) -> Column:
    """The last ``order`` symbols of a key."""
    return gram.bitwiseAND((1 << BITS * order) - 1)


def discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): discounts of counts 1, 2 and 3 or more, from counts of counts."""
    counts = grams.groupBy("lang").agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
    n1, n2, n3, n4 = (F.col(f"n{k}").cast("double") for k in (1, 2, 3, 4))
    y = F.try_divide(n1, n1 + 2 * n2)
    none, few = (n1 == 0) | (n2 == 0), (n3 == 0) | (n4 == 0)
    many = [1 - 2 * y * F.try_divide(n2, n1), 2 - 3 * y * F.try_divide(n3, n2), 3 - 4 * y * F.try_divide(n4, n3)]
    out = []
    for k, d in enumerate(many):
        bounded = F.least(F.greatest(d, F.lit(0.1)), F.lit(k + 0.9))
        out.append(F.when(none, 0.5).when(few, y).otherwise(bounded).alias(f"d{k + 1}"))
    return counts.select("lang", *out)


def fit(grams: DataFrame) -> DataFrame:
    """(lang, gram, log2p) for every row of counted ``grams``: interpolated over all orders."""
    levels = {ORDER: store(grams, "grams")}
    for order in range(ORDER - 1, 0, -1):  # continuation counts
        shorter = levels[order + 1].select("lang", _last(F.col("gram"), order).alias("gram"), (F.col("n") > 0).cast("long").alias("n"))
        levels[order] = store(shorter.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    below = None
    for order in range(1, ORDER + 1):
        table = levels[order].join(F.broadcast(discounts(levels[order])), "lang")
        n = F.col("n")
        cut = F.when(n == 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        table = table.select("lang", "gram", "n", F.least(cut, n.cast("double")).alias("cut"), F.shiftrightunsigned("gram", BITS).alias("context"))
        sums = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        # The empty context is one row for each language.
        table = table.join(F.broadcast(sums) if order == 1 else sums, ["lang", "context"])
        if below is None:
            lower = F.lit(2.0**-BITS)
        else:
            table = table.withColumn("suffix", _last(F.col("gram"), order - 1)).join(below, ["lang", "suffix"])
            lower = F.col("lower")
        seen = F.try_divide(n - F.col("cut"), F.col("total")) + F.greatest(F.try_divide(F.col("left"), F.col("total")), F.lit(1e-9)) * lower
        p = F.when(F.col("total") > 0, seen).otherwise(lower)
        if order == ORDER:
            return store(table.select("lang", "gram", F.log2(p).cast("float").alias("log2p")), "model")
        below = store(table.select("lang", F.col("gram").alias("suffix"), p.alias("lower")), "model")


def pack(docs: DataFrame, held: int = 1 << 25) -> DataFrame:
    """(chunk, rows): the other columns of ``docs`` in compressed batches, one for each chunk of about ``held`` bytes of a task."""

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        chunk = table["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        table, chunk = table.drop_columns(["chunk"]).take(order), chunk[order]
        heads = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])[: len(chunk)])
        rows = []
        for a, b in zip(heads, [*heads[1:], len(chunk)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(table.slice(a, b - a).combine_chunks())
            rows.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(chunk[heads], pa.int64()), pa.array(rows, pa.binary())], names=["chunk", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= held:
                yield packed(waiting)
                waiting, size = [], 0
        if waiting:
            yield packed(waiting)

    return docs.mapInArrow(run, "chunk long, rows binary")


def unpacked(group: pa.Table) -> pa.Table:
    """The rows of one chunk of ``pack``."""
    return pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in group["rows"].to_pylist())


def look_up(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(chunk, lang, gram, log2p) for the distinct grams of each chunk of ``docs``, which is packed."""

    def run(packed: pa.Table) -> pa.Table:
        group, by = unpacked(packed), {}
        for lang, text in zip(group["lang"].to_pylist(), group["text"].to_pylist()):
            if text:
                by.setdefault(lang, []).append(text)
        chunk, tables = packed["chunk"][0].as_py(), []
        for lang, texts in by.items():
            grams = np.unique(np.concatenate([np.unique(keys_of(texts[a:b])[0]) for a, b in charlm.chunks(texts)]))
            tables.append(pa.table({"chunk": np.full(len(grams), chunk), "lang": pa.array([lang] * len(grams), pa.string()), "gram": grams}))
        return pa.concat_tables(tables) if tables else pa.table({"chunk": np.empty(0, np.int64), "lang": pa.array([], pa.string()), "gram": np.empty(0, np.int64)})

    grams = docs.groupBy("chunk").applyInArrow(run, "chunk long, lang string, gram long")
    return grams.join(model, ["lang", "gram"]).select("chunk", "lang", "gram", "log2p")


def bits_of(langs: list[str], texts: list[str], looked: pa.Table) -> np.ndarray:
    """Mean bits a symbol of each text of a chunk; NaN for an empty text."""
    bits = np.full(len(texts), np.nan)
    names, grams, logs = np.array(looked["lang"].to_pylist(), dtype=object), looked["gram"].to_numpy(), looked["log2p"].to_numpy()
    for lang in set(langs):
        mine = names == lang
        order = np.argsort(grams[mine])
        known, values = grams[mine][order], logs[mine][order]
        own = [i for i, t in enumerate(texts) if t and langs[i] == lang]
        for a, b in charlm.chunks([texts[i] for i in own]):
            keys, sizes = keys_of([texts[i] for i in own[a:b]])
            found = values[np.searchsorted(known, keys)]
            bits[own[a:b]] = -np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.float64) / sizes
    return bits
