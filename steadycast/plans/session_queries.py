"""Registered queries: reshaping, sessions, features and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadycast.functions.scalar import (
    epoch_micros,
    micros_between,
    persistence_probability,
    decide,
)
from steadycast.operators import features, metrics, reshape, sessions, splits
from steadycast.operators.ranks import exact_quantiles
from steadycast.operators.slices import ordered
from steadycast.params import RESOLUTION_BY_BITRATE, TRAJECTORY
from steadycast.plans import views
from steadycast.plans.oracle import mean6, over
from steadycast.plans.registry import query

def ts_us():
    """The row time in microseconds."""
    return epoch_micros(F.col("timestamp")).alias("ts_us")


KEY = ["event_id", "bitrate_kbps"]


def r6(*names: str) -> list[F.Column]:
    """Columns rounded to six places."""
    return [F.round(n, 6).alias(n) for n in names]


def sql6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    "persistence_by_split",
    over(
        """SELECT split, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
             tp AS true_positives, n AS observations, round((tp + fn) / n, 6) AS positive_rate,
             round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
             round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
             round(fp / (fp + tn), 6) AS false_alarm_rate, round(fn / (fn + tp), 6) AS miss_rate
           FROM (SELECT split, count(*) AS n,
             count(*) FILTER (future_poor_qoe = 0 AND current_mos >= 3) AS tn,
             count(*) FILTER (future_poor_qoe = 0 AND current_mos < 3) AS fp,
             count(*) FILTER (future_poor_qoe = 1 AND current_mos >= 3) AS fn,
             count(*) FILTER (future_poor_qoe = 1 AND current_mos < 3) AS tp
             FROM kept GROUP BY split)"""
    ),
)
def persistence_by_split(spark, sf_dir):
    """How well the current state predicts the next row, per split."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    p = persistence_probability(F.col("current_mos"))
    df = t.frame.withColumn("prediction", decide(p, 0.5))
    out = metrics.decision_metrics(df, "future_poor_qoe", "prediction", ["split"])
    rates = ["positive_rate", "accuracy", "precision", "recall", "f1", "false_alarm_rate", "miss_rate"]
    return out.withColumns({c: F.round(c, 6) for c in rates})


@query(
    "unpivot_bitrates",
    over(f"SELECT event_id, bitrate_kbps, resolution, {sql6('plr_percent', 'current_mos')} FROM obs"),
)
def unpivot_bitrates(spark, sf_dir):
    """Wide form to long form."""
    long = reshape.wide_to_long(views.wide(spark, sf_dir), list(RESOLUTION_BY_BITRATE))
    return long.select("event_id", "bitrate_kbps", "resolution", *r6("plr_percent", "current_mos"))


@query(
    "canonical_names",
    "SELECT user_id, epoch_us(ts) AS ts_us, value AS throughput_mbps FROM events",
)
def canonical_names(spark, sf_dir):
    """Source names to canonical names."""
    e = views.table(spark, sf_dir, "events")
    raw = e.select(
        F.col("user_id").alias("User_ID"), F.col("ts").alias("Timestamp"), F.col("value").alias("Tput")
    )
    return reshape.canonical_names(raw).select("user_id", ts_us(), "throughput_mbps")


@query(
    "session_gaps",
    over("SELECT event_id, bitrate_kbps, gap_seconds, is_session_start FROM starts"),
)
def session_gaps(spark, sf_dir):
    """Gap to the previous row of the trajectory and session starts."""
    t = views.telemetry(spark, sf_dir)
    df = sessions.add_sessions(t.frame, views.SESSIONS, t.hot)
    return df.select(*KEY, "gap_seconds", "is_session_start")


@query(
    "session_ids",
    over("SELECT event_id, bitrate_kbps, session_number, session_id FROM sess"),
)
def session_ids(spark, sf_dir):
    """Session number and id."""
    t = views.telemetry(spark, sf_dir)
    df = sessions.add_sessions(t.frame, views.SESSIONS, t.hot)
    return df.select(*KEY, "session_number", "session_id")


@query(
    "future_target",
    over(
        f"""SELECT event_id, bitrate_kbps, {sql6('future_mos')},
            CAST(epoch_us(future_timestamp) AS DOUBLE) AS future_us, prediction_lead_seconds,
            CAST(future_poor_qoe AS DOUBLE) AS future_poor_qoe FROM lab"""
    ),
)
def future_target(spark, sf_dir):
    """Next row in the session: score, time, lead and label."""
    df = views.labelled(spark, sf_dir).frame
    return df.select(
        *KEY, *r6("future_mos"), epoch_micros(F.col("future_timestamp")).cast("double").alias("future_us"),
        "prediction_lead_seconds", F.col("future_poor_qoe").cast("double").alias("future_poor_qoe"),
    )


@query(
    "lag_features",
    over(
        f"""SELECT event_id, bitrate_kbps, {sql6('throughput_lag1', 'throughput_lag2', 'mos_lag1',
            'plr_lag1', 'latitude_lag1', 'longitude_lag1', 'throughput_change_1', 'mos_change_1',
            'plr_change_1')} FROM feat"""
    ),
)
def lag_features(spark, sf_dir):
    """Lags and one-step changes."""
    df = views.featured(spark, sf_dir).frame
    return df.select(
        *KEY,
        *r6("throughput_lag1", "throughput_lag2", "mos_lag1", "plr_lag1", "latitude_lag1",
            "longitude_lag1", "throughput_change_1", "mos_change_1", "plr_change_1"),
    )


ROLLING = [
    "throughput_past_mean_3", "mos_past_mean_3", "plr_past_mean_3", "throughput_past_mean_5",
    "mos_past_mean_5", "plr_past_mean_5", "throughput_past_std_5", "mos_past_std_5",
]


@query("rolling_features", over(f"SELECT event_id, bitrate_kbps, {sql6(*ROLLING)} FROM feat"))
def rolling_features(spark, sf_dir):
    """Means and sample deviations over the rows before the current one."""
    return views.featured(spark, sf_dir).frame.select(*KEY, *r6(*ROLLING))


@query(
    "rolling_extremes",
    over(
        """SELECT event_id, bitrate_kbps,
             round(min(throughput_mbps) OVER s, 6) AS past_min, round(max(throughput_mbps) OVER s, 6) AS past_max
           FROM lab WINDOW s AS (PARTITION BY session_id ORDER BY timestamp
             ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
    ),
)
def rolling_extremes(spark, sf_dir):
    """Past-only minimum and maximum."""
    t = views.labelled(spark, sf_dir)
    frame = ordered(t.frame, (*TRAJECTORY, "session_number"), ["timestamp"], t.hot, before=5)
    w = frame.window()
    df = frame.finish(
        frame.df.withColumns(
            {
                f"past_{s}": F.round(features.past_rolling("throughput_mbps", 5, s, w), 6)
                for s in ("min", "max")
            }
        )
    )
    return df.select(*KEY, "past_min", "past_max")


@query(
    "session_position",
    over("SELECT event_id, bitrate_kbps, session_step, elapsed_session_seconds FROM feat"),
)
def session_position(spark, sf_dir):
    """Position in the session and seconds since its first row."""
    return views.featured(spark, sf_dir).frame.select(*KEY, "session_step", "elapsed_session_seconds")


@query(
    "capacity_features",
    over(
        f"""SELECT event_id, bitrate_kbps, bitrate_mbps, {sql6('throughput_to_bitrate_ratio',
            'capacity_margin_mbps')}, CAST(capacity_insufficient AS INT) AS capacity_insufficient
            FROM feat"""
    ),
)
def capacity_features(spark, sf_dir):
    """Bitrate in Mbps, ratio, margin and shortfall flag."""
    df = views.featured(spark, sf_dir).frame
    return df.select(
        *KEY, "bitrate_mbps", *r6("throughput_to_bitrate_ratio", "capacity_margin_mbps"),
        F.col("capacity_insufficient").cast("int").alias("capacity_insufficient"),
    )


@query(
    "movement_features",
    over(f"SELECT event_id, bitrate_kbps, {sql6('movement_distance_km', 'movement_speed_kmh')} FROM feat"),
)
def movement_features(spark, sf_dir):
    """Distance from the previous row and speed."""
    df = views.featured(spark, sf_dir).frame
    return df.select(*KEY, *r6("movement_distance_km", "movement_speed_kmh"))


def _feature_sql(names: list[str]) -> str:
    exact = {"prb", "base_station", "session_step", "resolution", "bitrate_kbps"}
    whole = {"capacity_insufficient"}
    return ", ".join(
        n if n in exact else f"CAST({n} AS INT) AS {n}" if n in whole else f"round({n}, 6) AS {n}"
        for n in names
    )


def _rounded(df, names):
    exact = {"prb", "base_station", "session_step", "resolution", "bitrate_kbps"}
    return df.withColumns(
        {
            n: F.col(n).cast("int") if n == "capacity_insufficient" else F.round(n, 6)
            for n in names
            if n not in exact
        }
    )


@query(
    "network_feature_contract",
    over(f"SELECT event_id, {_feature_sql(features.NETWORK_FEATURES)} FROM kept WHERE split = 'train'"),
)
def network_feature_contract(spark, sf_dir):
    """The 16 ordered network features of the train rows."""
    t = views.with_split(spark, sf_dir, views.featured(spark, sf_dir))
    train = reshape.labelled_split(t.frame, "train")
    names = features.NETWORK_FEATURES
    return _rounded(features.select_features(train, names, ["event_id"]), names)


@query(
    "cross_layer_feature_contract",
    over(f"SELECT event_id, {_feature_sql(features.CROSS_LAYER_FEATURES)} FROM kept WHERE split = 'test'"),
)
def cross_layer_feature_contract(spark, sf_dir):
    """The 33 ordered cross-layer features of the test rows."""
    t = views.with_split(spark, sf_dir, views.featured(spark, sf_dir))
    test = reshape.labelled_split(t.frame, "test")
    names = features.CROSS_LAYER_FEATURES
    return _rounded(features.select_features(test, names, ["event_id"]), names)


@query(
    "history_snapshot",
    over(
        """SELECT event_id, bitrate_kbps, array_to_string(list(event_id) OVER s, ',') AS history,
             len(list(event_id) OVER s) AS size FROM lab
           WINDOW s AS (PARTITION BY session_id ORDER BY timestamp
             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
    ),
)
def history_snapshot(spark, sf_dir):
    """The last five rows of the session at each row."""
    t = views.labelled(spark, sf_dir)
    df = sessions.history(t.frame, ["event_id", "current_mos"], t.hot)
    ids = F.transform("history", lambda h: h["event_id"].cast("string"))
    return df.select(
        *KEY, F.array_join(ids, ",").alias("history"), F.size("history").cast("long").alias("size")
    )


@query(
    "latest_session_state",
    over(
        """SELECT session_id, event_id, round(current_mos, 6) AS current_mos,
             round(throughput_mbps, 6) AS throughput_mbps
           FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC) AS r
             FROM lab) WHERE r = 1"""
    ),
)
def latest_session_state(spark, sf_dir):
    """The last row of each session."""
    df = views.labelled(spark, sf_dir).frame
    out = sessions.latest_state(df, ["event_id", "current_mos", "throughput_mbps"])
    return out.select("session_id", "event_id", *r6("current_mos", "throughput_mbps"))


@query(
    "session_aggregates",
    over(
        f"""SELECT base_station, prb, bitrate_kbps, user_id, session_number,
             epoch_us(min(timestamp)) AS start_us, epoch_us(max(timestamp)) AS end_us,
             count(*) AS rows, {mean6("current_mos")} AS mean_mos
           FROM sess GROUP BY ALL"""
    ),
)
def session_aggregates(spark, sf_dir):
    """Start, end, rows and mean score per session."""
    t = views.telemetry(spark, sf_dir)
    df = sessions.session_summary(sessions.add_sessions(t.frame, views.SESSIONS, t.hot))
    return df.select(
        *TRAJECTORY, "session_number",
        epoch_micros(F.col("session_start")).alias("start_us"),
        epoch_micros(F.col("session_end")).alias("end_us"), "rows", *r6("mean_mos"),
    )


GAP_THRESHOLDS = [3600.0, 21600.0, 43200.0, 86400.0]


@query(
    "multi_threshold_gaps",
    "WITH g AS (SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY event_type, "
    "user_id ORDER BY ts), ts) / 1e6 AS gap FROM events) SELECT event_type, count(*) AS rows, "
    "count(gap) AS gap_count, "
    + ", ".join(
        f'count(*) FILTER (gap IS NULL OR gap > {t:g}) AS "sessions_gap_{t:g}s", '
        f'count(*) FILTER (gap > {t:g}) AS "breaks_gap_{t:g}s"'
        for t in GAP_THRESHOLDS
    )
    + " FROM g GROUP BY event_type",
)
def multi_threshold_gaps(spark, sf_dir):
    """Sessions and breaks for several gap thresholds, per event type."""
    e = views.table(spark, sf_dir, "events").select(
        "event_type", "user_id", F.col("ts").alias("timestamp")
    )
    keys = ["event_type", "user_id"]
    hot = sessions.find_hot_keys(e, keys)
    return sessions.gap_counts(e, keys, GAP_THRESHOLDS, ["event_type"], hot)


@query(
    "replay_order_violations",
    """WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate,
         lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)
       SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey AS sequence,
         CAST(o_orderdate AS VARCHAR)[1:10] AS day, CAST(prev AS VARCHAR)[1:10] AS previous_day
       FROM p WHERE o_orderdate < prev""",
)
def replay_order_violations(spark, sf_dir):
    """Orders delivered after a later-dated one of the same customer."""
    rows = views.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"),
        F.col("o_orderkey").alias("sequence"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
    )
    hot = sessions.find_hot_keys(rows, ["session_id"])
    out = sessions.order_violations(rows, "sequence", hot)
    return out.select(
        "session_id", "sequence",
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
        F.date_format("previous_timestamp", "yyyy-MM-dd").alias("previous_day"),
    )


@query(
    "split_boundaries",
    over(
        """SELECT n AS distinct_timestamps, epoch_us(train_end) AS train_end_us,
           epoch_us(validation_end) AS validation_end_us FROM bounds"""
    ),
)
def split_boundaries(spark, sf_dir):
    """Boundaries at the k-th distinct timestamps."""
    return splits.boundary_row(views.physical(spark, sf_dir).select("timestamp"))


@query("split_assignment", over("SELECT event_id, bitrate_kbps, split FROM splitted"))
def split_assignment(spark, sf_dir):
    """Split of every observation."""
    bounds = views.time_bounds(spark, sf_dir)
    return splits.assign_split(views.observations(spark, sf_dir), bounds).select(*KEY, "split")


@query("split_kept_rows", over("SELECT event_id, bitrate_kbps, split FROM kept"))
def split_kept_rows(spark, sf_dir):
    """Labelled rows whose label stays inside their split."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    return t.frame.select(*KEY, "split")


@query(
    "split_removals",
    over(
        """SELECT count(*) AS rows, count(*) FILTER (future_poor_qoe IS NULL) AS terminal_rows,
             count(*) FILTER (split = 'train' AND future_timestamp >= train_end) AS train_crossing_rows,
             count(*) FILTER (split = 'validation' AND future_timestamp >= validation_end)
               AS validation_crossing_rows FROM splitted"""
    ),
)
def split_removals(spark, sf_dir):
    """Rows removed, by reason."""
    t = views.labelled(spark, sf_dir)
    bounds = views.time_bounds(spark, sf_dir)
    return splits.removal_counts(splits.assign_split(t.frame, bounds), bounds)


_HALVES = dict(
    vstamps="SELECT DISTINCT timestamp AS t FROM kept WHERE split = 'validation'",
    vranked="SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM vstamps",
    mid="SELECT max(CASE WHEN i = CAST(floor(n * 0.5) AS BIGINT) THEN t END) AS midpoint FROM vranked",
    halves="""SELECT event_id, bitrate_kbps, CASE WHEN timestamp >= midpoint THEN 'select'
        WHEN future_timestamp < midpoint THEN 'fit' END AS half
        FROM kept CROSS JOIN mid WHERE split = 'validation'""",
)


@query("validation_halves", over("SELECT * FROM halves WHERE half IS NOT NULL", **_HALVES))
def validation_halves(spark, sf_dir):
    """Calibrator-fit and selection halves of the validation rows."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    fit, select = splits.halve_validation(t.frame.where(F.col("split") == "validation"))
    return fit.select(*KEY, F.lit("fit").alias("half")).unionByName(
        select.select(*KEY, F.lit("select").alias("half"))
    )


@query(
    "split_order",
    over(
        """SELECT split, epoch_us(min(timestamp)) AS first_us, epoch_us(max(timestamp)) AS last_us,
           count(*) AS rows FROM kept GROUP BY split"""
    ),
)
def split_order(spark, sf_dir):
    """Period of each split."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    return splits.split_order(t.frame)


@query(
    "split_summary",
    over(
        """SELECT split, count(*) AS rows, count(DISTINCT session_id) AS sessions,
             count(DISTINCT user_id) AS users, epoch_us(min(timestamp)) AS start_us,
             epoch_us(max(timestamp)) AS end_us, round(avg(future_poor_qoe), 6) AS poor_rate
           FROM kept GROUP BY split"""
    ),
)
def split_summary(spark, sf_dir):
    """Dataset summary per split."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    return splits.split_summary(t.frame).withColumn("poor_rate", F.round("poor_rate", 6))


@query(
    "labelled_split_rows",
    over(
        """SELECT event_id, bitrate_kbps, CAST(future_poor_qoe AS INT) AS future_poor_qoe
           FROM kept WHERE split = 'validation'"""
    ),
)
def labelled_split_rows(spark, sf_dir):
    """Validation rows with an integer label."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    return reshape.labelled_split(t.frame, "validation").select(*KEY, "future_poor_qoe")


@query(
    "prediction_stability",
    over("SELECT event_id, bitrate_kbps, round(prediction_stability, 6) AS prediction_stability FROM scored"),
)
def prediction_stability(spark, sf_dir):
    """Stability of the last six probabilities."""
    return views.scored(spark, sf_dir).frame.select(*KEY, *r6("prediction_stability"))


@query(
    "lead_quantiles_by_bitrate",
    over(
        """SELECT bitrate_kbps, count(prediction_lead_seconds) AS count,
             round(quantile_cont(prediction_lead_seconds, 0.1), 6) AS p10,
             round(quantile_cont(prediction_lead_seconds, 0.9), 6) AS p90
           FROM lab GROUP BY bitrate_kbps"""
    ),
)
def lead_quantiles_by_bitrate(spark, sf_dir):
    """Exact grouped quantiles without a value map per group."""
    df = views.labelled(spark, sf_dir).frame
    out = exact_quantiles(df, "prediction_lead_seconds", {"p10": 0.1, "p90": 0.9}, ["bitrate_kbps"])
    return out.select("bitrate_kbps", "count", *r6("p10", "p90"))
