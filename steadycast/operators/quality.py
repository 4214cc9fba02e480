"""Data contracts. Each check returns counts or violating rows; raising is separate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from steadycast.operators.slices import HotKeys, ordered
from steadycast.params import PHYSICAL_KEY, RESOLUTION_BY_BITRATE


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null cells per column, one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def key_contract(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, rows with a null key part, duplicated keys and surplus rows."""
    any_null = F.greatest(*[F.col(c).isNull().cast("int") for c in keys], F.lit(0)) == 1
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(any_null).alias("nulls")
    )
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.sum("nulls").alias("null_key_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.sum(F.col("n") - 1).alias("surplus_rows"),
    )


def non_increasing(df: DataFrame, keys: Sequence[str], sequence: str, hot: HotKeys | None = None) -> DataFrame:
    """Rows whose time is not after that of the previous row in stored sequence."""
    frame = ordered(df, keys, [sequence], hot, before=1)
    previous = F.lag("timestamp").over(frame.window())
    out = frame.finish(frame.df.withColumn("previous_timestamp", previous))
    return out.where(F.col("timestamp") <= F.col("previous_timestamp"))


def bitrate_domain(df: DataFrame, allowed: Mapping[int, str] = RESOLUTION_BY_BITRATE) -> DataFrame:
    """Per bitrate: rows, number of resolutions, and whether it is the allowed pair."""
    pair = F.lit(False)
    for bitrate, resolution in allowed.items():
        pair = pair | ((F.col("bitrate_kbps") == bitrate) & (F.col("resolution") == resolution))
    return df.groupBy("bitrate_kbps").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("resolution").alias("resolutions"),
        F.count_if(~F.coalesce(pair, F.lit(False))).alias("outside_domain"),
    )


def sibling_counts(df: DataFrame) -> DataFrame:
    """Distinct bitrates per physical observation."""
    return df.groupBy(*PHYSICAL_KEY).agg(F.countDistinct("bitrate_kbps").alias("siblings"))


def missing_siblings(df: DataFrame, expected: int) -> DataFrame:
    """Physical observations without all bitrates."""
    return sibling_counts(df).where(F.col("siblings") != expected)


def label_contract(df: DataFrame, poor_mos: float = 3.0) -> DataFrame:
    """One row of label violations: terminal rows per session, lead and strict rule."""
    rule = (F.col("future_mos") < F.lit(poor_mos)).cast("byte")
    per_session = df.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("future_poor_qoe").isNull()).alias("terminal"),
        F.count_if(F.col("prediction_lead_seconds") <= 0).alias("bad_lead"),
        F.count_if(~F.col("future_poor_qoe").cast("byte").eqNullSafe(rule)).alias("bad_label"),
    )
    return per_session.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("terminal").alias("terminal_rows"),
        F.count_if(F.col("terminal") != 1).alias("sessions_without_one_terminal"),
        F.sum("bad_lead").alias("non_positive_leads"),
        F.sum("bad_label").alias("label_rule_mismatches"),
    )


def boundary_values(df: DataFrame, column: str, values: Sequence[float]) -> DataFrame:
    """Rows equal to each boundary value, one row."""
    return df.agg(
        *[F.count_if(F.col(column) == F.lit(v)).alias(f"equal_{v:.3f}".replace(".", "_")) for v in values]
    )


def schema_differences(df: DataFrame, expected: StructType) -> list[str]:
    """Differences in names, order, types and nullability; empty when equal."""
    found = []
    if df.columns != expected.fieldNames():
        found.append(f"columns {df.columns} instead of {expected.fieldNames()}")
    for field in expected.fields:
        if field.name not in df.columns:
            continue
        actual = df.schema[field.name]
        if actual.dataType != field.dataType:
            found.append(f"{field.name}: {actual.dataType} instead of {field.dataType}")
        if actual.nullable and not field.nullable:
            found.append(f"{field.name} may not be null")
    return found


def value_domains(df: DataFrame, probabilities: Sequence[str], binaries: Sequence[str]) -> DataFrame:
    """Values outside [0, 1], not finite or null; and values outside {0, 1}. One row."""
    checks = []
    for c in probabilities:
        v = F.col(c)
        bad = v.isNull() | F.isnan(v) | (v < 0) | (v > 1)
        checks.append(F.count_if(bad).alias(f"bad_{c}"))
    for c in binaries:
        bad = F.col(c).isNull() | ~F.col(c).isin(0, 1)
        checks.append(F.count_if(bad).alias(f"bad_{c}"))
    return df.agg(F.count(F.lit(1)).alias("rows"), *checks)


def decision_agreement(df: DataFrame, probability: str, decision: str, stored: str, frozen: float) -> DataFrame:
    """Decisions that differ from p >= threshold and thresholds that differ from the frozen one."""
    again = (F.col(probability) >= F.lit(frozen)).cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col(decision).cast("int").eqNullSafe(again)).alias("decision_mismatches"),
        F.count_if(F.abs(F.col(stored) - F.lit(frozen)) > 1e-12).alias("threshold_mismatches"),
    )
