"""Joins that compare tables: key sets, sources, scenarios and stored results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.operators.metrics import assert_empty


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys not held exactly once by both sides, with their counts.

    Both sides are combined per key before the shuffle, so a repeated key costs one row.
    """
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        sides.groupBy(*keys)
        .agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
        .where((F.col("left_rows") != 1) | (F.col("right_rows") != 1))
    )


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Inner join on keys that must occur exactly once on both sides and hold no null."""
    if check:
        for side in (left, right):
            assert_empty(side.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])), "null in a key")
        assert_empty(key_differences(left, right, keys), "keys do not match one to one")
    return left.join(right, list(keys), "inner")


def not_selected(df: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was not selected yet."""
    return df.join(selected.select(*keys), list(keys), "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(picked).select(*keys, "__r.*")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows held by one side only, with the side that holds them."""
    only_left = left.subtract(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def source_reconciliation(
    rows: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """One row: rows without a source row, with several, and unequal values per column.

    Source rows are combined per key first, so an ambiguous key cannot multiply rows.
    """
    per_key = source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.min(v).alias(f"__s_{v}") for v in values]
    )
    joined = rows.select(*keys, *values).join(per_key, list(keys), "left")
    found = F.col("__n").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~found).alias("missing"),
        F.count_if(F.col("__n") > 1).alias("ambiguous"),
        *[
            F.count_if(found & ~F.col(v).eqNullSafe(F.col(f"__s_{v}"))).alias(f"{v}_mismatches")
            for v in values
        ],
    )


def _close(a: str, b: str) -> F.Column:
    both_null = F.col(a).isNull() & F.col(b).isNull()
    near = F.abs(F.col(a) - F.col(b)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col(b))
    return both_null | F.coalesce(near, F.lit(False))


def scenario_comparison(
    df: DataFrame, station: str, setting: str, keys: Sequence[str],
    same: Sequence[str], groups: dict[str, Sequence[str]],
) -> DataFrame:
    """Lowest and highest setting of each station, compared row by row on ``keys``.

    ``same`` columns must be equal everywhere; for each group of columns the share of
    close cells over matched rows is given.
    """
    values = [*same, *[c for cs in groups.values() for c in cs]]
    ends = df.groupBy(station).agg(F.min(setting).alias("lowest"), F.max(setting).alias("highest"))
    marked = df.join(ends, station).where(
        (F.col(setting) == F.col("lowest")) | (F.col(setting) == F.col("highest"))
    )
    # Both rows of a key meet in one combined aggregation instead of a self-join.
    low, high = F.col(setting) == F.col("lowest"), F.col(setting) == F.col("highest")
    paired = marked.groupBy(station, *keys).agg(
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.count_if(low).alias("a_n"), F.count_if(high).alias("b_n"),
        *[F.max(F.when(low, F.col(v))).alias(f"a_{v}") for v in values],
        *[F.max(F.when(high, F.col(v))).alias(f"b_{v}") for v in values],
    )
    matched = (F.col("a_n") > 0) & (F.col("b_n") > 0)
    equal = reduce(
        lambda x, y: x & y, [F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) for v in same], F.lit(True)
    )
    shares = []
    for name, columns in groups.items():
        close = sum((_close(f"a_{c}", f"b_{c}").cast("int") for c in columns), F.lit(0))
        shares.append(
            (F.sum(F.when(matched, close)) / (F.count_if(matched) * len(columns))).alias(
                f"{name}_equal_fraction"
            )
        )
    return paired.groupBy(station).agg(
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        (F.sum("a_n") == F.sum("b_n")).alias("same_number_of_rows"),
        (F.count_if(F.col("a_n") != F.col("b_n")) == 0).alias("same_keys"),
        (F.count_if(matched & ~equal) == 0).alias("same_values"),
        *shares,
    )


def stored_versus_recomputed(
    stored: DataFrame, rebuilt: DataFrame, keys: Sequence[str], columns: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """One row: keys on both sides, on one side only, repeated ones, and unequal values per column.

    Both sides meet in one combined aggregation. A key that is repeated on a side is counted as
    such and not compared. ``partitions`` is for tables too large for the session's number of shuffle partitions.
    """
    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.select(
            *keys, F.lit(1).alias(own), F.lit(0).alias(other),
            *[F.col(c).alias(f"{own}_{c}") for c in columns],
        )

    both = side(stored, "__s", "__r").unionByName(side(rebuilt, "__r", "__s"), allowMissingColumns=True)
    if partitions:
        both = both.repartition(partitions, *keys)
    per_key = both.groupBy(*keys).agg(
        F.sum("__s").alias("s"), F.sum("__r").alias("r"),
        *[F.max(f"__s_{c}").alias(f"s_{c}") for c in columns],
        *[F.max(f"__r_{c}").alias(f"r_{c}") for c in columns],
    )
    once = (F.col("s") == 1) & (F.col("r") == 1)
    return per_key.agg(
        F.count_if(once).alias("rows"),
        F.count_if(F.col("r") == 0).alias("stored_only"),
        F.count_if(F.col("s") == 0).alias("rebuilt_only"),
        F.count_if((F.col("s") > 1) | (F.col("r") > 1)).alias("repeated"),
        *[
            F.count_if(once & ~F.col(f"s_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(f"{c}_mismatches")
            for c in columns
        ],
    )


def metric_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Long metric tables (keys, value) that disagree or miss a row on either side."""
    a = left.select(*keys, F.col("value").alias("left_value"))
    b = right.select(*keys, F.col("value").alias("right_value"))
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    return a.join(b, list(keys), "full_outer").where(
        ~F.coalesce(gap <= F.lit(tolerance), F.col("left_value").isNull() & F.col("right_value").isNull())
    )


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Metric columns as rows (keys, metric, value)."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*keys, F.inline(cells))
