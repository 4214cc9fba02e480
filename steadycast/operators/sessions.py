"""Sessions from time gaps and labels from the next rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steadycast.functions.scalar import exact_mean, seconds_between
from steadycast.operators import slices
from steadycast.operators.slices import HotKeys, find_hot_keys, ordered
from steadycast.params import TRAJECTORY, SessionParams


def hot_trajectories(df: DataFrame, **options) -> HotKeys | None:
    """Trajectories too large for one task. No session can be hot if none of these is."""
    return find_hot_keys(df, TRAJECTORY, **options)


def lay_out(df: DataFrame, hot: HotKeys | None, before: int = 8, after: int = 1) -> DataFrame:
    """Cut hot trajectories once for sessions, labels, features and stability; ``slices.close`` ends the chain.

    Features look at five rows before a row. Where a filter of the chain drops rows between them, as
    the ``horizon`` rows in front of each of two split boundaries, ``before`` needs as many more.
    ``after`` is the horizon.
    """
    return slices.lay_out(df, TRAJECTORY, ["timestamp"], hot, before, after)


def add_sessions(
    df: DataFrame, params: SessionParams = SessionParams(), hot: HotKeys | None = None
) -> DataFrame:
    """Add gap, session start, session number and session id.

    A gap equal to the threshold stays in the session.
    """
    frame = ordered(df, TRAJECTORY, ["timestamp"], hot, before=1)
    w = frame.window()
    out = frame.df.withColumn(
        "gap_seconds", seconds_between(F.lag("timestamp").over(w), F.col("timestamp"))
    ).withColumn(
        "is_session_start",
        F.col("gap_seconds").isNull() | (F.col("gap_seconds") > F.lit(params.gap_seconds)),
    )
    if frame.sliced:
        out = frame.number_runs(out, F.col("is_session_start"), "timestamp", "session_number")
    else:
        running = F.sum(F.col("is_session_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("session_number", running.cast("int"))
    out = frame.finish(out)
    return out.withColumn("session_id", F.concat_ws("_", *TRAJECTORY, "session_number"))


def add_future_target(
    df: DataFrame, params: SessionParams = SessionParams(), hot: HotKeys | None = None
) -> DataFrame:
    """Add the value, time, lead and poor label ``horizon`` rows ahead in the session.

    Windows use the trajectory plus the session number, so the shuffle made for the
    sessions is reused.
    """
    frame = ordered(df, (*TRAJECTORY, "session_number"), ["timestamp"], hot, after=params.horizon)
    w = frame.window()
    out = frame.df.withColumns(
        {
            "future_mos": F.lead("current_mos", params.horizon).over(w),
            "future_timestamp": F.lead("timestamp", params.horizon).over(w),
        }
    ).withColumns(
        {
            "prediction_lead_seconds": seconds_between(
                F.col("timestamp"), F.col("future_timestamp")
            ),
            "future_poor_qoe": (F.col("future_mos") < F.lit(params.poor_mos)).cast("byte"),
        }
    )
    return frame.finish(out)


def label(
    df: DataFrame, params: SessionParams = SessionParams(), hot: HotKeys | None = None
) -> DataFrame:
    """Sessions and labels. Works on stored rows too: derived columns are replaced."""
    derived = [
        "gap_seconds", "is_session_start", "session_number", "session_id",
        "future_mos", "future_timestamp", "prediction_lead_seconds", "future_poor_qoe",
    ]
    return add_future_target(add_sessions(df.drop(*derived), params, hot), params, hot)


def gap_counts(
    df: DataFrame,
    keys: list[str],
    thresholds: list[float],
    groups: list[str],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Sessions and breaks per group for several thresholds, from one lag window."""
    frame = ordered(df, keys, ["timestamp"], hot, before=1)
    gap = seconds_between(F.lag("timestamp").over(frame.window()), F.col("timestamp"))
    gaps = frame.finish(frame.df.withColumn("gap_seconds", gap))
    counts = []
    for t in thresholds:
        over = F.col("gap_seconds") > F.lit(t)
        counts += [
            F.count_if(F.col("gap_seconds").isNull() | over).alias(f"sessions_gap_{t:g}s"),
            F.count_if(over).alias(f"breaks_gap_{t:g}s"),
        ]
    return gaps.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.count("gap_seconds").alias("gap_count"), *counts
    )


def add_gap(df: DataFrame, keys: list[str], hot: HotKeys | None = None) -> DataFrame:
    """Seconds since the previous row of the key."""
    frame = ordered(df, keys, ["timestamp"], hot, before=1)
    gap = seconds_between(F.lag("timestamp").over(frame.window()), F.col("timestamp"))
    return frame.finish(frame.df.withColumn("gap_seconds", gap))


def session_summary(df: DataFrame) -> DataFrame:
    """Start, end, rows and mean score per session. Combined before the shuffle."""
    return df.groupBy(*TRAJECTORY, "session_number").agg(
        F.min("timestamp").alias("session_start"),
        F.max("timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("rows"),
        exact_mean(F.col("current_mos")).alias("mean_mos"),
    )


def latest_state(df: DataFrame, fields: list[str]) -> DataFrame:
    """Last row per session, as columns. Combined before the shuffle."""
    newest = F.max_by(F.struct(*fields), F.col("timestamp")).alias("__last")
    return df.groupBy("session_id").agg(newest).select("session_id", "__last.*")


def history(
    df: DataFrame, fields: list[str], hot: HotKeys | None = None, size: int = 5
) -> DataFrame:
    """The last ``size`` rows of the session up to each row, current row included."""
    frame = ordered(df, (*TRAJECTORY, "session_number"), ["timestamp"], hot, before=size)
    w = frame.window().rowsBetween(-(size - 1), 0)
    return frame.finish(
        frame.df.withColumn("history", F.collect_list(F.struct(*fields)).over(w))
    )


def order_violations(df: DataFrame, sequence: str, hot: HotKeys | None = None) -> DataFrame:
    """Rows whose time is before that of the row delivered earlier in the session.

    ``sequence`` is a stored delivery number; row order inside files means nothing here.
    """
    frame = ordered(df, ("session_id",), [sequence], hot, before=1)
    previous = F.lag("timestamp").over(frame.window())
    out = frame.finish(frame.df.withColumn("previous_timestamp", previous))
    return out.where(F.col("timestamp") < F.col("previous_timestamp"))
