"""Columnar feature tables, CSV exports and one-row documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadycast.operators.features import require_columns


def write_feature_table(df: DataFrame, path: str, order: Sequence[str] = ("timestamp", "session_id")) -> None:
    """Parquet by split, rows in time order inside evenly sized files.

    Range partitioning samples the times, so a busy period is spread over several files.
    """
    keys = ["split", *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of one split; other splits are not listed and other columns not read."""
    table = spark.read.parquet(path)
    require_columns(table.columns, list(columns), f"feature table {path}")
    return table.where(F.col("split") == split).select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def document(spark: SparkSession, fields: dict[str, object], **tables: DataFrame) -> DataFrame:
    """One row with constant fields and, per table, an array of its rows.

    For small report tables only; each must have at most a few rows per group.
    """
    parts = [spark.range(1).select(*[_literal(v).alias(k) for k, v in fields.items()])]
    for name, table in tables.items():
        rows = F.collect_list(F.struct(*sorted(table.columns)))
        parts.append(table.agg(F.sort_array(rows).alias(name)))
    # Single rows with one column set each, put side by side.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def _literal(value: object) -> Column:
    if isinstance(value, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def write_document(df: DataFrame, path: str) -> None:
    """A document as JSON, null fields kept."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
