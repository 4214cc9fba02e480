"""Deterministic, seedable samples by strata.

Rows are ordered by a hash of their key and the seed. Ranks are taken first inside salted
parts of a stratum, so no stratum is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadycast.functions.scalar import epoch_micros
from steadycast.operators.reshape import undecided
from steadycast.params import ROW_KEY

SALTS = 256


def key_hash(seed: int, *columns: Column) -> Column:
    """md5 of the key columns and the seed, as text."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns], F.lit(str(seed))))


def row_hash(seed: int) -> Column:
    """Hash of the evaluation row key."""
    return key_hash(seed, F.col("session_id"), F.col("user_id"), epoch_micros(F.col("timestamp")))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows per group, through salted partial ranks."""
    by = [F.col(c) for c in order]
    salt = F.pmod(F.xxhash64(*by), F.lit(SALTS)).alias("__salt")
    partial = Window.partitionBy(*groups, "__salt").orderBy(*by)
    final = Window.partitionBy(*groups).orderBy(*by)
    return (
        df.select("*", salt)
        .withColumn("__rank", F.row_number().over(partial))
        .where(F.col("__rank") <= limit)
        .withColumn("__rank", F.row_number().over(final))
        .where(F.col("__rank") <= limit)
        .drop("__salt", "__rank")
    )


# Review strata.
POOR, ACCEPTABLE, ABSTENTION = "accepted_poor_qoe", "accepted_acceptable_qoe", "abstention"


def review_category() -> Column:
    """Stratum of a decided row; a missing decision is an error."""
    return (
        F.when(undecided(), F.raise_error(F.lit("a decision is missing")).cast("string"))
        .when(F.col("abstain"), ABSTENTION)
        .when(F.col("predicted_poor_qoe") == 1, POOR)
        .otherwise(ACCEPTABLE)
    )


def review_sample(df: DataFrame, seed: int, per_category: int = 10, check: bool = True) -> DataFrame:
    """``per_category`` rows of each stratum; fewer available is an error."""
    tagged = df.withColumns({"category": review_category(), "__hash": row_hash(seed)})
    picked = top_per_group(tagged, ["category"], ["__hash", *ROW_KEY], per_category).drop("__hash")
    if check:
        sizes = {r["category"]: r["count"] for r in picked.groupBy("category").count().collect()}
        for name in (POOR, ACCEPTABLE, ABSTENTION):
            if sizes.get(name, 0) < per_category:
                raise ValueError(f"category {name} has {sizes.get(name, 0)} of {per_category} rows")
    return picked


DIVERSE_STRATA = ["trust_level", "predicted_poor_qoe", "actual_future_poor_qoe"]


def diverse_sample(df: DataFrame, cases: int, seed: int) -> DataFrame:
    """About equal numbers per (level, decision, outcome), topped up from the rest.

    One row per key is kept. The number of strata is small: it is counted first.
    """
    tagged = df.withColumns({"__h1": row_hash(seed), "__h2": row_hash(seed + 1)})
    strata = df.select(*DIVERSE_STRATA).distinct().count()
    if not strata:
        raise ValueError("there are no prediction groups")
    each = max(cases // strata, 1)
    first = top_per_group(tagged, DIVERSE_STRATA, ["__h1", *ROW_KEY], each)
    first = first.dropDuplicates(list(ROW_KEY)).withColumn("__pass", F.lit(1))
    rest = tagged.join(first.select(*ROW_KEY), list(ROW_KEY), "left_anti")
    # Distributed top-k: each task keeps at most ``cases`` rows.
    rest = rest.orderBy("__h2", *ROW_KEY).limit(cases).withColumn("__pass", F.lit(2))
    both = first.unionByName(rest)
    order = F.when(F.col("__pass") == 1, F.col("__h1")).otherwise(F.col("__h2"))
    return both.orderBy("__pass", order, *ROW_KEY).limit(cases).drop("__h1", "__h2", "__pass")
