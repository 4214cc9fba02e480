"""Exact order statistics and running totals over a whole table.

``Window.orderBy`` without a partition puts all rows into one task. Here equal values are
combined first, distinct values are dealt out by ranges of about equal row counts, totals run
inside a range, and the totals of the other ranges are added as an offset. The number of ranges
follows the counted rows without a bound, and one path serves all sizes.

Nulls are left out by the callers. NaN is a value: it is greater than all others, and all NaN
are equal.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadycast.session import shared_dir

ROWS_PER_RANGE = 2_000_000
RANGE = "__range"


def by_ranges(counts: DataFrame, value: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``counts``, stored and dealt out by ranges of ``value``, with the number of the range.

    The bounds come from a seeded sample of stored rows, so they are the same each time the
    result is computed.
    """
    shared_dir(counts.sparkSession)
    stored = counts.checkpoint()
    parts = max(1, -(-stored.count() // rows_per_range))
    return stored.repartitionByRange(parts, value).withColumn(RANGE, F.spark_partition_id())


def running_totals(
    counts: DataFrame,
    value: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    *,
    descending: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add inclusive running totals ``cum_*`` and group totals ``tot_*``.

    ``counts`` must hold one row per (group, value) and ``value`` must be a double.
    """
    groups = list(groups)
    ranged = by_ranges(counts, value, rows_per_range)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*groups, RANGE).orderBy(direction(value))
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums})
    # A row for each range of a group: as many as ranges, not as values.
    totals = ranged.groupBy(*groups, RANGE).agg(*[F.sum(s).alias(s) for s in sums])
    across = Window.partitionBy(*groups).orderBy(direction(RANGE))
    across = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    totals = totals.select(
        *[F.col(c).alias(f"__r_{c}") for c in (*groups, RANGE)],
        *[F.coalesce(F.sum(s).over(across), F.lit(0)).alias(f"__o_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"tot_{s}") for s in sums],
    )
    match = reduce(
        lambda a, b: a & b, [local[c].eqNullSafe(totals[f"__r_{c}"]) for c in (*groups, RANGE)]
    )
    joined = local.join(totals, match).withColumns(
        {f"cum_{s}": F.col(f"cum_{s}") + F.col(f"__o_{s}") for s in sums}
    )
    dropped = [f"__r_{c}" for c in (*groups, RANGE)] + [f"__o_{s}" for s in sums]
    return joined.drop(RANGE, *dropped)


def numbered(df: DataFrame, order: Sequence[str], name: str, *, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add consecutive numbers from 1 in the order of ``order``, whose values must be unique.

    Rows are dealt out by ranges and numbered inside them; the rows of the ranges before are added.
    """
    shared_dir(df.sparkSession)
    stored = df.checkpoint()
    parts = max(1, -(-stored.count() // rows_per_range))
    # The bounds come from a seeded sample of stored rows, so both uses below see the same ranges.
    ranged = stored.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order)).cast("long")
    sizes = ranged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(RANGE).alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = ranged.withColumn(name, inside)
    out = local.join(sizes, F.col(RANGE) == F.col("__r")).withColumn(name, F.col("__before") + F.col(name))
    return out.drop(RANGE, "__r", "__before")


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Non-null values with their counts, as (groups, ``__v`` double, ``__n``)."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )


def _at(position: Column) -> Column:
    """The value whose run of equal rows covers a 0-based position."""
    covers = (F.col("cum___n") - F.col("__n") <= position) & (position < F.col("cum___n"))
    return F.max(F.when(covers, F.col("__v")))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: Sequence[str] = (),
    *,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per group: each named quantile with linear interpolation, plus ``count``."""
    counts = value_counts(df, value, groups)
    ranked = running_totals(counts, "__v", ["__n"], groups, rows_per_range=rows_per_range)
    aggregates = [F.max("tot___n").alias("count")]
    for name, q in probs.items():
        exact = (F.col("tot___n") - 1) * F.lit(q)
        aggregates += [
            _at(F.floor(exact)).alias(f"__lo_{name}"),
            _at(F.ceil(exact)).alias(f"__hi_{name}"),
        ]
    wide = ranked.groupBy(*groups).agg(*aggregates)
    share = {n: (F.col("count") - 1) * F.lit(q) for n, q in probs.items()}
    return wide.select(
        *groups,
        "count",
        *[
            (
                F.col(f"__lo_{n}")
                + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * (share[n] - F.floor(share[n]))
            ).alias(n)
            for n in probs
        ],
    )


def approximate_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Mergeable-summary variant: one pass, rank error of one in ``accuracy``."""
    column = F.col(value).cast("double")
    return df.groupBy(*groups).agg(
        F.count(column).alias("count"),
        *[F.percentile_approx(column, q, accuracy).alias(n) for n, q in probs.items()],
    )


def nth_distinct(
    df: DataFrame, value: str, picks: dict[str, float], *, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """One row: the distinct value at index ``floor(count * share)`` for each name.

    The index is bounded by the last value; ``count`` is the number of distinct values.
    """
    distinct = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v"))
    distinct = distinct.distinct().withColumn("__n", F.lit(1).cast("long"))
    ranked = running_totals(distinct, "__v", ["__n"], rows_per_range=rows_per_range)
    total = F.col("tot___n")
    wanted = {
        n: F.least(F.floor(total.cast("double") * F.lit(share)), total - 1)
        for n, share in picks.items()
    }
    return ranked.agg(
        F.max("tot___n").alias("count"), *[_at(p).alias(n) for n, p in wanted.items()]
    )
