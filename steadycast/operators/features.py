"""Features that use only the current and earlier rows of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steadycast.functions.scalar import (
    capacity_columns,
    haversine_km,
    seconds_between,
    speed_kmh,
    stability_from_spread,
)
from steadycast.operators.slices import BEGAN, STEP, HotKeys, ordered
from steadycast.params import SESSION

# The two ordered feature contracts.
NETWORK_FEATURES = [
    "throughput_mbps", "prb", "base_station", "latitude", "longitude", "gap_seconds",
    "throughput_lag1", "throughput_lag2", "throughput_change_1", "throughput_past_mean_3",
    "throughput_past_mean_5", "throughput_past_std_5", "movement_distance_km",
    "movement_speed_kmh", "session_step", "elapsed_session_seconds",
]
CROSS_LAYER_FEATURES = NETWORK_FEATURES + [
    "bitrate_kbps", "resolution", "plr_percent", "current_mos", "mos_lag1", "plr_lag1",
    "mos_change_1", "plr_change_1", "mos_past_mean_3", "mos_past_mean_5", "mos_past_std_5",
    "plr_past_mean_3", "plr_past_mean_5", "bitrate_mbps", "throughput_to_bitrate_ratio",
    "capacity_margin_mbps", "capacity_insufficient",
]
CATEGORICAL_FEATURES = ["resolution"]
RETROSPECTIVE = {
    "future_mos", "future_timestamp", "future_poor_qoe", "prediction_lead_seconds",
}

_LAGS = {
    "throughput_lag1": ("throughput_mbps", 1),
    "throughput_lag2": ("throughput_mbps", 2),
    "mos_lag1": ("current_mos", 1),
    "plr_lag1": ("plr_percent", 1),
    "latitude_lag1": ("latitude", 1),
    "longitude_lag1": ("longitude", 1),
}
_SHORT = {"throughput": "throughput_mbps", "mos": "current_mos", "plr": "plr_percent"}
_ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def past_rolling(column: str, size: int, statistic: str, window) -> F.Column:
    """A statistic over the ``size`` rows before the current one."""
    if statistic not in _ROLLING:
        raise ValueError(f"unknown rolling statistic: {statistic}")
    return _ROLLING[statistic](column).over(window.rowsBetween(-size, -1))


def add_features(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Lags, changes, past rolling statistics, capacity, movement and position."""
    frame = ordered(df, SESSION, ["timestamp"], hot, before=5)
    w = frame.window()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = frame.df
    if STEP in out.columns:
        position, started = F.col(STEP), F.col(BEGAN)
    elif frame.sliced:
        out = frame.carry(out, sums={"__rows": F.lit(1).cast("long")}, mins={"__start": F.col("timestamp")})
        position = F.col("__rows") + F.sum(frame.own().cast("long")).over(upto) - 1
        started = F.least("__start", F.min(F.when(frame.own(), F.col("timestamp"))).over(upto))
    else:
        position = F.row_number().over(w) - 1
        started = F.min("timestamp").over(upto)
    columns = {name: F.lag(c, k).over(w) for name, (c, k) in _LAGS.items()}
    for short, column in _SHORT.items():
        for size in (3, 5):
            columns[f"{short}_past_mean_{size}"] = past_rolling(column, size, "mean", w)
    for short in ("throughput", "mos"):
        columns[f"{short}_past_std_5"] = past_rolling(_SHORT[short], 5, "std", w)
    columns["session_step"] = position.cast("int")
    columns["__first"] = started
    out = frame.finish(out.withColumns(columns))
    out = out.withColumns(
        {
            "throughput_change_1": F.col("throughput_mbps") - F.col("throughput_lag1"),
            "mos_change_1": F.col("current_mos") - F.col("mos_lag1"),
            "plr_change_1": F.col("plr_percent") - F.col("plr_lag1"),
            **capacity_columns(F.col("throughput_mbps"), F.col("bitrate_kbps")),
            "movement_distance_km": haversine_km(
                F.col("latitude"), F.col("longitude"),
                F.col("latitude_lag1"), F.col("longitude_lag1"),
            ),
            "elapsed_session_seconds": seconds_between(F.col("__first"), F.col("timestamp")),
        }
    ).withColumn(
        "movement_speed_kmh", speed_kmh(F.col("movement_distance_km"), F.col("gap_seconds"))
    )
    return out.drop("__rows", "__start", "__first")


def prediction_stability(
    df: DataFrame, probability: str, hot: HotKeys | None = None, size: int = 5
) -> DataFrame:
    """Add ``prediction_stability`` from the last ``size`` and the current probability."""
    frame = ordered(df, SESSION, ["timestamp"], hot, before=size)
    spread = F.stddev_pop(probability).over(frame.window().rowsBetween(-size, 0))
    return frame.finish(
        frame.df.withColumn("prediction_stability", stability_from_spread(spread))
    )


def select_features(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """The ordered feature contract after any key columns; future columns are refused."""
    leaked = RETROSPECTIVE & set(names)
    if leaked:
        raise ValueError(f"retrospective columns are not features: {sorted(leaked)}")
    require_columns(df.columns, names, "feature selection")
    return df.select(*(keep or []), *[n for n in names if n not in (keep or [])])


def require_columns(available: list[str], required: list[str], context: str) -> None:
    """Raise when a required column is absent; nothing is dropped silently."""
    missing = [c for c in required if c not in set(available)]
    if missing:
        raise ValueError(f"{context} is missing columns: {', '.join(missing)}")
