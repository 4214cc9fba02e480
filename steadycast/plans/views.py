"""Telemetry views over the given tables.

``events`` stands in for telemetry: each event becomes one physical observation, seen at
four bitrates. Sessions end after a day, as events of a user are hours apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadycast.functions.scalar import (
    abstains,
    clip01,
    configured_trust,
    data_quality,
    decide,
    probability_confidence,
    trust_level,
)
from steadycast.operators.features import NETWORK_FEATURES, add_features, prediction_stability
from steadycast.operators.reshape import long_to_wide
from steadycast.operators.sessions import label, lay_out
from steadycast.operators.slices import HotKeys, close, find_hot_keys
from steadycast.operators.splits import (
    Boundaries,
    assign_split,
    boundaries,
    remove_crossing_targets,
)
from steadycast.params import RESOLUTION_BY_BITRATE, SessionParams, TrustPolicy

SESSIONS = SessionParams(gap_seconds=86400.0)
TAU, F1, ECE, ABSTENTION = 0.5, 0.8, 0.1, 0.62
POLICY = TrustPolicy()
ROWS_PER_TASK = 150_000
"""Physical rows a task sorts for windows; they become four times as many and wider."""
PHYSICAL = ["base_station", "mobility", "prb", "user_id", "timestamp"]
RADIO = [*PHYSICAL, "throughput_mbps", "latitude", "longitude"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK) -> int | None:
    """Partitions for so many rows, or None where the session's number of shuffle partitions is enough."""
    wanted = -(-rows // per_task)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per physical observation."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        (F.col("user_id") % 4 + 1).alias("base_station"),
        F.lit("Driver").alias("mobility"),
        (5 * (F.col("user_id") % 8 + 1)).alias("prb"),
        "user_id",
        F.col("ts").alias("timestamp"),
        (F.col("value") / 10.0).alias("throughput_mbps"),
        (44 + (F.col("event_id") % 1000) / 10000).alias("latitude"),
        (12 + (F.col("event_id") * 7 % 1000) / 10000).alias("longitude"),
    )


def observations(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """One row per physical observation and bitrate.

    ``by_user`` shuffles the physical rows by station, setting and user before they are
    unpivoted. Later windows by trajectory reuse that placement, so a quarter of the rows
    crosses the network.
    """
    cells = F.array(
        *[
            F.struct(F.lit(b).cast("long").alias("bitrate_kbps"), F.lit(r).alias("resolution"))
            for b, r in RESOLUTION_BY_BITRATE.items()
        ]
    )
    served = F.least(F.lit(1.0), F.col("throughput_mbps") / (F.col("bitrate_kbps") / 1000))
    rows = physical(spark, sf_dir)
    if by_user:
        # Without a number adaptive execution sizes the partitions by their bytes, but makes no more of them than
        # the session's number; a table too large for that gets partitions by its counted rows.
        tasks = tasks_for(spark, rows.count())
        rows = rows.repartition(*([tasks] if tasks else []), "base_station", "prb", "user_id")
    long = rows.select("*", F.inline(cells))
    return long.withColumns(
        {"current_mos": 1 + 4 * served, "plr_percent": 100 * (1 - served)}
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide form: one row per physical observation, paired columns per bitrate."""
    return long_to_wide(
        observations(spark, sf_dir), ["event_id", *RADIO], list(RESOLUTION_BY_BITRATE)
    )


@dataclass(frozen=True)
class Telemetry:
    """Observations with the hot keys found once; ``laid`` is the same frame, cut for more of the chain."""

    frame: DataFrame
    hot: HotKeys | None
    laid: DataFrame | None = None


def telemetry(spark: SparkSession, sf_dir: str) -> Telemetry:
    # All bitrates of a user have the rows of the user: physical rows are counted, before they are unpivoted.
    hot = find_hot_keys(physical(spark, sf_dir), ["base_station", "prb", "user_id"])
    # A hot trajectory must not be gathered before it is cut into slices.
    return Telemetry(observations(spark, sf_dir, by_user=hot is None), hot)


def _chain(laid: DataFrame, hot: HotKeys | None) -> Telemetry:
    return Telemetry(close(laid), hot, laid)


def labelled(spark: SparkSession, sf_dir: str) -> Telemetry:
    """Sessions and next-row labels."""
    t = telemetry(spark, sf_dir)
    # Five rows for features and stability, two for the rows that go at each of two split boundaries.
    laid = lay_out(t.frame, t.hot, 5 + 2 * SESSIONS.horizon, SESSIONS.horizon)
    return _chain(label(laid, SESSIONS), t.hot)


def featured(spark: SparkSession, sf_dir: str) -> Telemetry:
    """Labels and past-only features."""
    t = labelled(spark, sf_dir)
    return _chain(add_features(t.laid), t.hot)


def time_bounds(spark: SparkSession, sf_dir: str) -> Boundaries:
    """Split boundaries; only the time column of ``events`` is read."""
    return boundaries(physical(spark, sf_dir).select("timestamp"))


def with_split(spark: SparkSession, sf_dir: str, t: Telemetry) -> Telemetry:
    """Assign splits and drop rows without a usable label."""
    bounds = time_bounds(spark, sf_dir)
    return _chain(remove_crossing_targets(assign_split(t.laid, bounds), bounds), t.hot)


def closed_form_probability() -> F.Column:
    """A probability from the current score alone, so results need no fitted model."""
    return F.round(clip01((5 - F.col("current_mos")) / 4), 6)


def scored(spark: SparkSession, sf_dir: str) -> Telemetry:
    """Labelled rows with split, probability, decision and the trust fields."""
    t = with_split(spark, sf_dir, featured(spark, sf_dir))
    df = t.laid.withColumn("calibrated_probability", closed_form_probability())
    df = prediction_stability(df, "calibrated_probability")
    p = F.col("calibrated_probability")
    df = df.withColumns(
        {
            "predicted_poor_qoe": decide(p, TAU),
            "actual_future_poor_qoe": F.col("future_poor_qoe").cast("int"),
            "model_confidence": probability_confidence(p, TAU),
            "data_quality": data_quality(df.columns, NETWORK_FEATURES),
        }
    )
    df = df.withColumn(
        "trust_score",
        F.round(
            configured_trust(F.col("model_confidence"), F1, ECE, F.col("data_quality"), POLICY), 9
        ),
    )
    score = F.col("trust_score")
    df = df.withColumns(
        {
            "trust_level": trust_level(score, POLICY.high, POLICY.medium),
            "abstain": abstains(score, ABSTENTION, POLICY),
        }
    )
    return _chain(df, t.hot)
