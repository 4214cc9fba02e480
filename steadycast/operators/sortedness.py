"""Whether stored rows are in order, without sorting them.

A stretch of rows of one file gives a summary: its first and last key, its rows, and how often a row is
less than the one before. Summaries are merged in the order in which the rows are stored, first
inside a file, then in the order of file names; a merge adds a break where one stretch ends above the
next one's beginning. Nulls come before all values and NaN behind them, as in an ascending sort.

Rows stay where the scan reads them. What is moved is one row for each batch of a file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

FILE, ROW = "__file", "__row"


def _descents(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """For each row but the first, whether its key is less than that of the row before."""
    n = batch.num_rows
    less, equal = np.zeros(n - 1, bool), np.ones(n - 1, bool)

    def compare(values: pa.Array) -> None:
        nonlocal less, equal
        before, here = values.slice(0, n - 1), values.slice(1)
        below = pc.fill_null(pc.less(here, before), False).to_numpy(zero_copy_only=False)
        same = pc.fill_null(pc.equal(here, before), False).to_numpy(zero_copy_only=False)
        less, equal = less | (equal & below), equal & same

    for name in columns:
        values = batch.column(name)
        compare(pc.cast(values.is_valid(), pa.int8()))
        if pa.types.is_floating(values.type):
            nan = pc.fill_null(pc.is_nan(values), False)
            compare(pc.cast(nan, pa.int8()))
            values = pc.if_else(nan, pa.scalar(0.0, values.type), values)
        if values.null_count:
            known = values.drop_null()
            values = values.fill_null(known[0]) if len(known) else pa.array([0] * n)
        compare(values)
    return less


def runs(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summaries of stretches of rows that carry ``FILE`` and ``ROW``: file, at, rows, breaks, first, last."""
    columns = list(columns)
    key = StructType([StructField(c, rows.schema[c].dataType) for c in columns])
    out = StructType(
        [StructField("file", StringType()), *(StructField(c, LongType()) for c in ("at", "rows", "breaks")), StructField("first", key), StructField("last", key)]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, at = batch.column(FILE).to_numpy(zero_copy_only=False), batch.column(ROW).to_numpy()
            if not len(at):
                continue
            cut = np.flatnonzero((files[1:] != files[:-1]) | (at[1:] != at[:-1] + 1)) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(at))
            down = np.append(0, np.append(0, _descents(batch, columns)).cumsum())
            breaks = down[ends] - down[starts + 1]
            keys = pa.StructArray.from_arrays([batch.column(c) for c in columns], names=columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(FILE).take(pa.array(starts)), pa.array(at[starts]), pa.array(ends - starts), pa.array(breaks.astype(np.int64)),
                 keys.take(pa.array(starts)), keys.take(pa.array(ends - 1))],
                names=["file", "at", "rows", "breaks", "first", "last"],
            )

    return rows.select(FILE, ROW, *columns).mapInArrow(work, out)


def _of_files(parts: DataFrame) -> DataFrame:
    """Summaries merged inside each file."""
    w = Window.partitionBy("file").orderBy("at")
    torn = (F.col("first") < F.lag("last").over(w)).cast("long")
    parts = parts.withColumn("torn", F.coalesce(torn, F.lit(0)))
    return parts.groupBy("file").agg(
        F.sum("rows").alias("rows"), (F.sum("breaks") + F.sum("torn")).alias("breaks"),
        F.min_by("first", "at").alias("first"), F.max_by("last", "at").alias("last"),
    )


def sortedness(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One row about a stored Parquet table: files, rows, breaks (rows less than the one before), sorted.

    An empty table is sorted. The order across files is that of their names.
    """
    table = spark.read.parquet(path)
    rows = table.select(*columns, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    files = _of_files(runs(rows, columns))
    # One row for each file, as many as the driver lists for the scan.
    torn = (F.col("first") < F.lag("last").over(Window.orderBy("file"))).cast("long")
    whole = files.withColumn("torn", F.coalesce(torn, F.lit(0))).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("breaks") + F.sum("torn"), F.lit(0)).alias("breaks"),
    )
    return whole.withColumn("sorted", F.col("breaks") == 0)
