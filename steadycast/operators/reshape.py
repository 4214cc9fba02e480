"""Projections and reshaping: wide to long, names, decisions and evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadycast.functions.scalar import decide
from steadycast.params import RESOLUTION_BY_BITRATE

# Source names and canonical names.
CANONICAL_NAMES = {
    "User_ID": "user_id",
    "Timestamp": "timestamp",
    "Tput": "throughput_mbps",
    "Latitude": "latitude",
    "Longitude": "longitude",
}


def loss_column(bitrate: int, resolutions: Mapping[int, str] = RESOLUTION_BY_BITRATE) -> str:
    return f"{resolutions[bitrate]}_{bitrate}kbps"


def mos_column(bitrate: int) -> str:
    return f"MOS_{bitrate}kbps"


def wide_to_long(
    df: DataFrame,
    bitrates: Sequence[int],
    resolutions: Mapping[int, str] = RESOLUTION_BY_BITRATE,
) -> DataFrame:
    """One row per bitrate with its loss and score, in one pass over the wide rows."""
    pairs = [c for b in bitrates for c in (loss_column(b, resolutions), mos_column(b))]
    missing = [c for c in pairs if c not in df.columns]
    if missing:
        raise ValueError(f"wide table is missing columns: {', '.join(missing)}")
    cells = F.array(
        *[
            F.struct(
                F.lit(b).cast("long").alias("bitrate_kbps"),
                F.lit(resolutions[b]).alias("resolution"),
                F.col(loss_column(b, resolutions)).cast("double").alias("plr_percent"),
                F.col(mos_column(b)).cast("double").alias("current_mos"),
            )
            for b in bitrates
        ]
    )
    return df.select(*[c for c in df.columns if c not in pairs], F.inline(cells))


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename source columns."""
    return df.withColumnsRenamed(CANONICAL_NAMES)


def long_to_wide(df: DataFrame, keys: Sequence[str], bitrates: Sequence[int]) -> DataFrame:
    """Inverse of :func:`wide_to_long` for one row per (keys, bitrate)."""
    cells = []
    for b in bitrates:
        here = F.col("bitrate_kbps") == b
        cells += [
            F.max(F.when(here, F.col("plr_percent"))).alias(loss_column(b)),
            F.max(F.when(here, F.col("current_mos"))).alias(mos_column(b)),
        ]
    return df.groupBy(*keys).agg(*cells)


def labelled_split(df: DataFrame, split: str, target: str = "future_poor_qoe") -> DataFrame:
    """Rows of a split that hold a label, with the label as an integer."""
    return df.where((F.col("split") == split) & F.col(target).isNotNull()).withColumn(
        target, F.col(target).cast("int")
    )


def selection_predictions(
    df: DataFrame, model: str, method: str, probability: str, threshold: float,
    target: str = "future_poor_qoe",
) -> DataFrame:
    """Output rows of the selection period for one model and calibration method."""
    return df.select(
        "session_id", "user_id", "timestamp", "future_timestamp", "prediction_lead_seconds", target,
        F.lit(model).alias("model"),
        F.lit(method).alias("calibration_method"),
        F.col(probability).alias("probability_poor_qoe"),
        decide(F.col(probability), threshold).alias("predicted_poor_qoe"),
        F.lit(threshold).alias("decision_threshold"),
    )


def undecided() -> Column:
    """True where neither an abstention nor a prediction is stated."""
    return F.col("abstain").isNull() | (~F.col("abstain") & F.col("predicted_poor_qoe").isNull())


def decision_label() -> Column:
    """'abstain', 'future_poor_qoe' or 'future_acceptable_qoe'; a missing decision is an error."""
    return (
        F.when(undecided(), F.raise_error(F.lit("a decision is missing")).cast("string"))
        .when(F.col("abstain"), "abstain")
        .when(F.col("predicted_poor_qoe") == 1, "future_poor_qoe")
        .otherwise("future_acceptable_qoe")
    )


# The evidence allow-list, in order, and the fields rounded to 4 places.
EVIDENCE_FIELDS = (
    "prediction", "prediction_probability", "trust_score", "trust_level", "current_mos",
    "throughput_mbps", "bitrate_kbps", "capacity_margin_mbps", "throughput_to_bitrate_ratio",
    "plr_percent",
)


def evidence(probability: str = "calibrated_probability") -> Column:
    """The allow-listed evidence of a decided row as a struct."""
    sources = {"prediction": decision_label(), "prediction_probability": F.col(probability)}
    fields = []
    for name in EVIDENCE_FIELDS:
        column = sources.get(name, F.col(name))
        if name == "bitrate_kbps":
            column = column.cast("long")
        elif name not in ("prediction", "trust_level"):
            column = F.round(column.cast("double"), 4)
        fields.append(column.alias(name))
    return F.struct(*fields)


def accepted(df: DataFrame) -> DataFrame:
    """Rows the system does not abstain on."""
    return df.where(~F.col("abstain"))
