"""Comparison of large stored tables by a tree of digests.

Rows belong to a bucket of the hash of their key, on two levels: ``outer`` buckets are folders of
the stored table, ``inner`` buckets divide them. A bucket's digest does not depend on the order of
its rows. To compare two tables, the sums of outer buckets are compared first, then the inner
buckets of those that differ, and only rows of inner buckets that differ are read and joined;
folders of equal outer buckets are not listed.

A digest holds the number of rows and two sums of 64-bit row hashes with different seeds. Nulls and
their places are part of a row hash. Two tables that differ only in a bucket with equal counts
and equal sums count as equal there, which for unlike rows is a matter of 128 bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadycast.operators.reconcile import stored_versus_recomputed

BUCKET = ["outer_bucket", "inner_bucket"]
# What tells two buckets apart.
DIGEST = ["n", "first_sum", "second_sum"]


@dataclass(frozen=True)
class Tree:
    """Numbers of buckets. The table of digests has at most ``outer * inner`` rows at every size."""

    outer: int = 32
    inner: int = 512
    files: int = 8  # tasks that write one folder


@dataclass(frozen=True)
class Comparison:
    """``summary``: the row of ``reconcile.stored_versus_recomputed``. ``buckets``: those that differ,
    with rows on either side. ``stored`` and ``rebuilt``: the rows that were read."""

    summary: DataFrame
    buckets: DataFrame
    stored: DataFrame
    rebuilt: DataFrame


def _hash(columns: Sequence[str], seed: int) -> Column:
    """A row hash; a null is told from any value and keeps its place."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def store(df: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str], tree: Tree = Tree()) -> None:
    """Write the table in folders of outer buckets to ``path/rows`` and its digests to ``path/digests``."""
    spread = F.pmod(_hash(keys, 11), F.lit(tree.outer * tree.inner))
    rows = df.select(*keys, *columns).withColumns(
        {"outer_bucket": F.floor(spread / tree.inner).cast("int"), "inner_bucket": (spread % tree.inner).cast("int")}
    )
    # A folder is dealt to several tasks by whole rows, so that one hot key does not stay in one task.
    part = F.pmod(_hash([*keys, *columns], 12), F.lit(tree.files))
    rows = rows.repartition("outer_bucket", part).sortWithinPartitions(*BUCKET)
    rows.write.partitionBy("outer_bucket").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/columns")  # an empty table has no folders to tell its columns
    written = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    digests(written, keys, columns).coalesce(1).write.parquet(f"{path}/digests")


def digests(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per inner bucket: digest, keys that occur once, and keys that are repeated.

    Rows of one key are combined before the shuffle.
    """
    exact = lambda seed: F.sum(_hash([*keys, *columns], seed).cast("decimal(20,0)"))
    per_key = rows.groupBy(*BUCKET, *keys).agg(F.count("*").alias("n"), exact(21).alias("x"), exact(22).alias("y"))
    total = lambda c: F.sum(c).cast("decimal(38,0)")
    return per_key.groupBy(*BUCKET).agg(
        F.sum("n").alias("n"), total("x").alias("first_sum"), total("y").alias("second_sum"),
        F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("repeated"),
    )


def _unlike(left: DataFrame, right: DataFrame, level: Sequence[str]) -> DataFrame:
    """Buckets of a level whose digests differ, with the rows of both sides."""
    sides = [side.groupBy(*level).agg(*[F.sum(c).alias(f"{mark}_{c}") for c in DIGEST]) for side, mark in ((left, "l"), (right, "r"))]
    same = [F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in DIGEST]
    both = sides[0].join(sides[1], list(level), "full_outer").where(~(same[0] & same[1] & same[2]))
    return both.select(*level, F.coalesce("l_n", F.lit(0)).alias("stored_rows"), F.coalesce("r_n", F.lit(0)).alias("rebuilt_rows"))


def compare(spark: SparkSession, stored: str, rebuilt: str, keys: Sequence[str], columns: Sequence[str]) -> Comparison:
    """Compare two tables written by ``store`` with the same keys, columns and tree.

    The driver sees numbers of outer buckets, ``Tree.outer`` at most. Empty tables have no buckets
    and are equal. Counts of keys in equal buckets come from the digests.
    """
    sums = [spark.read.parquet(f"{p}/digests") for p in (stored, rebuilt)]
    outer = sorted(r.outer_bucket for r in _unlike(*sums, BUCKET[:1]).collect())
    inside = F.col("outer_bucket").isin(outer)
    buckets = _unlike(*(s.where(inside) for s in sums), BUCKET)
    # At most outer * inner pairs of numbers, whatever the tables hold.
    chosen = F.broadcast(buckets.select(*BUCKET))
    left, right = (
        spark.read.schema(spark.read.parquet(f"{p}/columns").schema).parquet(f"{p}/rows").where(inside).join(chosen, BUCKET, "left_semi").select(*keys, *columns)
        for p in (stored, rebuilt)
    )
    alike = sums[0].join(chosen, BUCKET, "left_anti").agg(
        F.coalesce(F.sum("once"), F.lit(0)).alias("rows"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated")
    )
    found = stored_versus_recomputed(left, right, keys, columns)
    # Both sides are one row; the sum over them adds the keys of equal buckets.
    both = found.unionByName(alike, allowMissingColumns=True)
    summary = both.agg(*[F.sum(c).alias(c) for c in found.columns])
    return Comparison(summary, buckets, left, right)

