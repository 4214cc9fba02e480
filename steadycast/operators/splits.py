"""Chronological splits without leakage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadycast.functions.scalar import epoch_micros
from steadycast.operators.ranks import nth_distinct
from steadycast.params import SplitParams, unit_interval


@dataclass(frozen=True)
class Boundaries:
    """First microsecond (since 1970) of the validation and of the test period."""

    train_end: int
    validation_end: int


def _micros(df: DataFrame, column: str = "timestamp") -> Column:
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return epoch_micros(F.col(column))
    return F.unix_micros(F.col(column))


def boundary_row(df: DataFrame, params: SplitParams = SplitParams(), **options) -> DataFrame:
    """One row: distinct timestamps and both boundaries in microseconds."""
    stamps = df.select(_micros(df).cast("double").alias("__t"))
    shares = {"train_end_us": params.train, "validation_end_us": params.train + params.validation}
    found = nth_distinct(stamps, "__t", shares, **options)
    return found.select(
        F.col("count").alias("distinct_timestamps"),
        *[F.col(n).cast("long").alias(n) for n in shares],
    )


def boundaries(df: DataFrame, params: SplitParams = SplitParams(), **options) -> Boundaries:
    """Both boundaries as driver values (two numbers)."""
    row = boundary_row(df, params, **options).first()
    if row["train_end_us"] is None:
        raise ValueError("cannot split an empty table")
    return Boundaries(row["train_end_us"], row["validation_end_us"])


def assign_split(df: DataFrame, bounds: Boundaries) -> DataFrame:
    """Add ``split``; rows with the same timestamp stay together."""
    t = _micros(df)
    return df.withColumn(
        "split",
        F.when(t < bounds.train_end, "train")
        .when(t < bounds.validation_end, "validation")
        .otherwise("test"),
    )


def _crossings(df: DataFrame, bounds: Boundaries) -> tuple[Column, Column]:
    future = _micros(df, "future_timestamp")
    train = (F.col("split") == "train") & (future >= bounds.train_end)
    validation = (F.col("split") == "validation") & (future >= bounds.validation_end)
    return train, validation


def remove_crossing_targets(df: DataFrame, bounds: Boundaries) -> DataFrame:
    """Keep labelled rows whose future row lies in their own split."""
    train, validation = _crossings(df, bounds)
    labelled = F.col("future_timestamp").isNotNull() & F.col("future_poor_qoe").isNotNull()
    return df.where(labelled & ~train & ~validation)


def removal_counts(df: DataFrame, bounds: Boundaries) -> DataFrame:
    """Rows kept and rows removed, by reason, in one pass."""
    train, validation = _crossings(df, bounds)
    terminal = F.col("future_timestamp").isNull() | F.col("future_poor_qoe").isNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(terminal).alias("terminal_rows"),
        F.count_if(~terminal & train).alias("train_crossing_rows"),
        F.count_if(~terminal & validation).alias("validation_crossing_rows"),
    )


def halve_validation(
    validation: DataFrame, fraction: float = 0.5, target: str = "future_poor_qoe", **options
) -> tuple[DataFrame, DataFrame]:
    """Calibrator-fit and selection halves; fit labels end before the midpoint."""
    unit_interval(fraction, "fraction", open_ends=True)
    stamps = validation.select(_micros(validation).cast("double").alias("__t"))
    row = nth_distinct(stamps, "__t", {"midpoint": fraction}, **options).first()
    index = int((row["count"] or 0) * fraction)
    if not row["count"] or index <= 0 or index >= row["count"]:
        raise ValueError("both halves of the validation period need timestamps")
    midpoint = int(row["midpoint"])
    valid = validation.where(F.col(target).isNotNull() & F.col("future_timestamp").isNotNull())
    early = _micros(validation) < midpoint
    fit = valid.where(early & (_micros(validation, "future_timestamp") < midpoint))
    select = valid.where(~early)
    if fit.isEmpty() or select.isEmpty():
        raise ValueError("both halves of the validation period need rows")
    return fit, select


def split_order(df: DataFrame) -> DataFrame:
    """First and last time and row count per split."""
    t = _micros(df)
    return df.groupBy("split").agg(
        F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count(F.lit(1)).alias("rows")
    )


def check_split_order(df: DataFrame) -> None:
    """Raise when a split is empty or periods overlap (three rows reach the driver)."""
    found = {r["split"]: r for r in split_order(df).collect()}
    if set(found) != {"train", "validation", "test"}:
        raise ValueError("every split must contain rows")
    for early, late in (("train", "validation"), ("validation", "test")):
        if found[early]["last_us"] >= found[late]["first_us"]:
            raise ValueError(f"{early} and {late} periods overlap")


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, sessions, users, period and poor rate per split."""
    t = _micros(df)
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("user_id").alias("users"),
        F.min(t).alias("start_us"),
        F.max(t).alias("end_us"),
        F.avg("future_poor_qoe").alias("poor_rate"),
    )
