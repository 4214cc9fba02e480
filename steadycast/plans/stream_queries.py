"""Registered queries: streams over the events, checked against the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadycast.functions.scalar import epoch_micros
from steadycast.operators import sessions
from steadycast.params import RESOLUTION_BY_BITRATE, TRAJECTORY
from steadycast.plans import views
from steadycast.plans.oracle import mean6, over
from steadycast.plans.registry import query
from steadycast.plans.session_queries import KEY, ROLLING, r6, sql6
from steadycast.session import run_dir
from steadycast.streaming import replay as stream_ops
from steadycast.streaming.runner import read_stream, run_available


def _derived(events):
    """The observation columns of an event stream or table."""
    cells = F.array(
        *[
            F.struct(F.lit(b).cast("long").alias("bitrate_kbps"), F.lit(r).alias("resolution"))
            for b, r in RESOLUTION_BY_BITRATE.items()
        ]
    )
    served = F.least(F.lit(1.0), F.col("throughput_mbps") / (F.col("bitrate_kbps") / 1000))
    return (
        events.select(
            "event_id",
            (F.col("user_id") % 4 + 1).alias("base_station"),
            (5 * (F.col("user_id") % 8 + 1)).alias("prb"),
            "user_id",
            epoch_micros(F.col("ts")).alias("ts_us"),
            (F.col("value") / 10.0).alias("throughput_mbps"),
            (44 + (F.col("event_id") % 1000) / 10000).alias("latitude"),
            (12 + (F.col("event_id") * 7 % 1000) / 10000).alias("longitude"),
            F.inline(cells),
        )
        .withColumns({"current_mos": 1 + 4 * served, "plr_percent": 100 * (1 - served)})
    )


def observation_stream(spark, sf_dir):
    return _derived(read_stream(spark, sf_dir, "events.parquet"))


def by_user_and_bitrate(stream):
    return stream.withColumn("session_id", F.concat_ws("_", "user_id", "bitrate_kbps"))


def of_session(session):
    parts = F.split(session, "_")
    return parts[0].cast("long").alias("user_id"), parts[1].cast("long").alias("bitrate_kbps")


ONLINE = [
    "throughput_lag1", "throughput_lag2", "mos_lag1", "plr_lag1", "latitude_lag1",
    "longitude_lag1", *ROLLING,
]


@query(
    "stream_features",
    over(
        f"""SELECT event_id, bitrate_kbps, gap_seconds, session_number, session_step,
            elapsed_session_seconds, {sql6(*ONLINE)} FROM feat"""
    ),
)
def stream_features(spark, sf_dir):
    """Sessions and features computed on the stream."""
    out = run_available(stream_ops.online_features(observation_stream(spark, sf_dir), views.SESSIONS))
    return out.select(
        *KEY, "gap_seconds", "session_number", "session_step", "elapsed_session_seconds", *r6(*ONLINE)
    )


@query(
    "stream_replay",
    over(
        """SELECT event_id, user_id, round(least(1.0, greatest(0.0, (5 - current_mos) / 4)), 6) AS probability,
             (round(least(1.0, greatest(0.0, (5 - current_mos) / 4)), 6) >= 0.5)::INT AS prediction,
             array_to_string(list(event_id) OVER (PARTITION BY user_id, bitrate_kbps ORDER BY timestamp
               ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS history, bitrate_kbps
           FROM obs"""
    ),
)
def stream_replay(spark, sf_dir):
    """Replay with a user at a bitrate as session: score and history at every row."""
    stream = by_user_and_bitrate(observation_stream(spark, sf_dir))

    def score(df):
        return df.withColumn("probability", views.closed_form_probability())

    out = run_available(stream_ops.replay(stream, score))
    return out.select(
        "event_id", *of_session("session_id"), "probability", "prediction",
        F.array_join(F.transform("history", lambda e: e.cast("string")), ",").alias("history"),
    )


@query(
    "stream_late_rows",
    """SELECT 4 * count(*) AS rows, CAST(4 * count(*) FILTER (event_id % 10 = 0 AND ts < newest) AS BIGINT) AS late_rows
       FROM (SELECT *, max(ts) FILTER (event_id % 10 <> 0) OVER (PARTITION BY user_id) AS newest FROM events)""",
)
def stream_late_rows(spark, sf_dir):
    """Every tenth event comes in a second batch: those older than what came before are late."""
    e = views.table(spark, sf_dir, "events")
    path = run_dir(spark, "late-source")
    e.where("event_id % 10 != 0").write.parquet(path)
    first = len(spark.read.parquet(path).inputFiles())
    e.where("event_id % 10 = 0").coalesce(first).write.mode("append").parquet(path)
    stream = _derived(read_stream(spark, path, "*.parquet", max_files=first))
    return stream_ops.late_rows(run_available(stream_ops.online_features(stream, views.SESSIONS)))


@query(
    "stream_latest_state",
    """SELECT user_id, bitrate_kbps, event_id, epoch_us(ts) AS ts_us
       FROM events, (VALUES (2000::BIGINT), (4000), (6000), (8000)) b(bitrate_kbps)
       QUALIFY row_number() OVER (PARTITION BY user_id, bitrate_kbps ORDER BY ts DESC) = 1""",
)
def stream_latest_state(spark, sf_dir):
    """Last row per user and bitrate, kept up to date by the stream."""
    stream = by_user_and_bitrate(observation_stream(spark, sf_dir))
    out = run_available(stream_ops.latest_state_stream(stream, ["event_id", "ts_us"]), "update")
    newest = F.max_by(F.struct("event_id", "ts_us"), F.col("batch")).alias("n")
    return out.groupBy("session_id").agg(newest).select(*of_session("session_id"), "n.*")


@query(
    "stream_session_aggregates",
    over(
        f"""SELECT base_station, prb, bitrate_kbps, user_id, epoch_us(min(timestamp)) AS start_us,
             epoch_us(max(timestamp)) AS end_us, count(*) AS rows, {mean6("current_mos")} AS mean_mos,
             session_number = max(session_number) OVER (PARTITION BY base_station, prb, bitrate_kbps, user_id) AS open
           FROM sess GROUP BY base_station, prb, bitrate_kbps, user_id, session_number"""
    ),
)
def stream_session_aggregates(spark, sf_dir):
    """All sessions of the stream; the last one of each trajectory is still open."""
    updates = run_available(stream_ops.session_aggregates_stream(observation_stream(spark, sf_dir), views.SESSIONS), "update")
    out = stream_ops.latest_sessions(updates)
    return out.select(*TRAJECTORY, "start_us", "end_us", "rows", *r6("mean_mos"), "open")


@query(
    "stream_batch_parity",
    over("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS stream_only, CAST(0 AS BIGINT) AS batch_only FROM obs"),
)
def stream_batch_parity(spark, sf_dir):
    """Rows of the stream that differ from the batch, both ways."""
    columns = [*KEY, "session_number", "session_step", *r6("gap_seconds", "elapsed_session_seconds", *ONLINE)]
    online = run_available(stream_ops.online_features(observation_stream(spark, sf_dir), views.SESSIONS))
    online = online.select(*columns)
    batch = views.featured(spark, sf_dir).frame.select(*columns)
    sides = online.withColumn("side", F.lit(1)).unionByName(batch.withColumn("side", F.lit(-1)))
    # Equal rows of both sides meet in one combined aggregation.
    per_row = sides.groupBy(*[c for c in sides.columns if c != "side"]).agg(
        F.sum("side").alias("balance"), F.count_if(F.col("side") == 1).alias("online")
    )
    return per_row.agg(
        F.sum("online").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("balance") > 0, F.col("balance"))), F.lit(0)).alias("stream_only"),
        F.coalesce(F.sum(F.when(F.col("balance") < 0, -F.col("balance"))), F.lit(0)).alias("batch_only"),
    )


@query(
    "future_invariance",
    over("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM obs WHERE epoch_us(timestamp) < (SELECT epoch_us(train_end) FROM bounds)"),
)
def future_invariance(spark, sf_dir):
    """Features of the train period when all later rows are altered: none may change."""
    from steadycast.operators.features import add_features

    bounds = views.time_bounds(spark, sf_dir)
    early = epoch_micros(F.col("timestamp")) < bounds.train_end
    t = views.telemetry(spark, sf_dir)
    altered = t.frame.withColumns(
        {c: F.when(early, F.col(c)).otherwise(F.col(c) * 3 + 7) for c in ("throughput_mbps", "current_mos", "plr_percent")}
    )
    names = ["session_step", "gap_seconds", *ONLINE]

    def past(frame):
        df = add_features(sessions.add_sessions(frame, views.SESSIONS, t.hot), t.hot)
        return df.where(early).select(*KEY, *names)

    a, b = past(t.frame), past(altered).withColumnsRenamed({n: f"b_{n}" for n in names})
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"b_{n}"))
    return a.join(b, KEY).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("changed"))
