"""Profiles of telemetry tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.functions.scalar import exact_mean
from steadycast.operators.ranks import approximate_quantiles, exact_quantiles


def with_quantiles(
    stats: DataFrame,
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """Add quantiles of ``value`` to a table of other statistics per group.

    The two small tables are put together by a union and a grouping, which also matches
    null groups and works without groups.
    """
    found = (exact_quantiles if exact else approximate_quantiles)(df, value, probs, groups)
    found = found.drop("count")
    names = [c for c in stats.columns if c not in groups]
    both = stats.unionByName(found, allowMissingColumns=True)
    return both.groupBy(*groups).agg(*[F.max(c).alias(c) for c in [*names, *probs]])


def table_profile(df: DataFrame, group: str, user: str, time: str, value: str) -> DataFrame:
    """Rows, users, null cells, duplicate rows, period and value range per group and overall.

    The overall row has a null group. Duplicates are rows minus distinct rows: equal rows
    are combined before anything is grouped.
    """
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    distinct = distinct.withColumn("__nulls", nulls * F.col("__n"))
    n = F.col("__n")
    per_user = distinct.groupingSets(
        [[F.col(group), F.col(user)], [F.col(user)]], F.col(group), F.col(user)
    ).agg(
        F.grouping(group).alias("overall"),
        F.sum(n).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.sum("__nulls").alias("null_cells"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.sum(n * F.col(value)).alias("__sum"),
        F.sum(F.when(F.col(value).isNotNull(), n)).alias("__values"),
    )
    return per_user.groupBy("overall", group).agg(
        F.sum("rows").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.count(user).alias("users"),
        F.sum("null_cells").alias("null_cells"),
        (F.sum("rows") - F.sum("distinct_rows")).alias("duplicate_rows"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
        (F.sum("__sum") / F.sum("__values")).alias("mean"),
    )


def bitrate_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Loss, score and capacity relations per bitrate."""
    short = F.col("throughput_mbps") < F.col("bitrate_kbps") / F.lit(1000.0)
    stats = df.groupBy("bitrate_kbps").agg(
        F.min("plr_percent").alias("min_loss"),
        exact_mean(F.col("plr_percent")).alias("mean_loss"),
        F.max("plr_percent").alias("max_loss"),
        F.avg((F.col("plr_percent") == 0).cast("double")).alias("zero_loss_share"),
        F.min("current_mos").alias("min_mos"),
        exact_mean(F.col("current_mos")).alias("mean_mos"),
        F.max("current_mos").alias("max_mos"),
        F.corr("plr_percent", "current_mos").alias("corr_loss_mos"),
        F.corr("throughput_mbps", "current_mos").alias("corr_throughput_mos"),
        F.avg(short.cast("double")).alias("below_capacity_share"),
        exact_mean(F.when(~short, F.col("current_mos"))).alias("mean_mos_sufficient"),
        exact_mean(F.when(short, F.col("current_mos"))).alias("mean_mos_insufficient"),
    )
    medians = {"median_loss": 0.5}
    out = with_quantiles(stats, df, "plr_percent", medians, ["bitrate_kbps"], exact)
    return with_quantiles(out, df, "current_mos", {"median_mos": 0.5}, ["bitrate_kbps"], exact)


def column_summary(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Minimum, mean, median, maximum and sample deviation per column, from one unpivot."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    long = df.select(F.inline(cells))
    stats = long.groupBy("column").agg(
        F.min("value").alias("minimum"),
        exact_mean(F.col("value")).alias("mean"),
        F.max("value").alias("maximum"),
        F.stddev_samp("value").alias("standard_deviation"),
    )
    return with_quantiles(stats, long, "value", {"median": 0.5}, ["column"], exact)


def gap_statistics(
    gaps: DataFrame, groups: Sequence[str], probs: dict[str, float], exact: bool = True
) -> DataFrame:
    """Minimum, mean, maximum and quantiles of ``gap_seconds`` per group."""
    stats = gaps.where(F.col("gap_seconds").isNotNull()).groupBy(*groups).agg(
        F.min("gap_seconds").alias("minimum_gap_seconds"),
        exact_mean(F.col("gap_seconds")).alias("mean_gap_seconds"),
        F.max("gap_seconds").alias("maximum_gap_seconds"),
    )
    return with_quantiles(stats, gaps, "gap_seconds", probs, groups, exact)


def label_overview(df: DataFrame, exact: bool = True) -> DataFrame:
    """Label counts, poor rate, sessions, users and median lead."""
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("future_poor_qoe").alias("labelled_rows"),
        F.count_if(F.col("future_poor_qoe") == 1).alias("poor_rows"),
        F.count_if(F.col("future_poor_qoe") == 0).alias("acceptable_rows"),
        F.avg("future_poor_qoe").alias("poor_rate"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("user_id").alias("users"),
    )
    return with_quantiles(stats, df, "prediction_lead_seconds", {"median_lead": 0.5}, (), exact)


def dimension_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column with their row counts, one row per value."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(cells)).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("rows")
    )


LEAD_QUANTILES = {
    "p25_seconds": 0.25, "median_seconds": 0.5, "p75_seconds": 0.75,
    "p90_seconds": 0.90, "p95_seconds": 0.95,
}


def lead_time_statistics(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Count, extremes, mean and quantiles; text that is not a number counts as missing."""
    values = df.select(F.expr(f"try_cast(`{column}` as double)").alias("v"))
    values = values.where(F.col("v").isNotNull() & ~F.isnan("v"))
    stats = values.agg(
        F.count("v").alias("count"),
        F.min("v").alias("minimum_seconds"),
        exact_mean(F.col("v")).alias("mean_seconds"),
        F.max("v").alias("maximum_seconds"),
    )
    return with_quantiles(stats, values, "v", LEAD_QUANTILES, (), exact)


def histogram(df: DataFrame, column: str, upto: float = 0.99, bins: int = 40) -> DataFrame:
    """Equal bins over the values up to a quantile; the last bin is closed.

    The three bounds reach the driver as numbers.
    """
    cut = exact_quantiles(df, column, {"cut": upto}).first()["cut"]
    values = df.where(F.col(column) <= F.lit(cut)).select(F.col(column).cast("double").alias("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None or low == high:
        low, high = (0.0, 1.0) if low is None else (low - 0.5, high + 0.5)
    index = F.least(F.width_bucket(F.col("v"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return values.groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
