"""Sessions, labels, features and splits on hand-written cases, and hot-key slices."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from steadycast.operators import features, sessions, slices, splits
from steadycast.operators.slices import find_hot_keys, ordered
from steadycast.params import TRAJECTORY, SessionParams, SplitParams
from steadycast.plans import views

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "base_station long, prb long, bitrate_kbps long, user_id long, timestamp timestamp_ntz, "
    "current_mos double"
)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def trajectory(spark, rows):
    return spark.createDataFrame([(1, 10, 4000, 7, at(s), m) for s, m in rows], SCHEMA)


def labelled(spark, rows, **params):
    return sessions.label(trajectory(spark, rows), SessionParams(**params)).orderBy("timestamp").collect()


def test_gap_boundary_stays_in_session(spark):
    got = labelled(spark, [(61, 2.0), (30, 3.0), (0, 4.0)])
    assert [r.gap_seconds for r in got] == [None, 30.0, 31.0]
    assert [r.is_session_start for r in got] == [True, False, True]
    assert [r.session_number for r in got] == [1, 1, 2]
    assert [r.session_id for r in got] == ["1_10_4000_7_1", "1_10_4000_7_1", "1_10_4000_7_2"]


def test_next_row_label(spark):
    got = labelled(spark, [(0, 2.0), (8, 4.0), (20, 2.5)])
    assert [r.future_mos for r in got] == [4.0, 2.5, None]
    assert [r.future_poor_qoe for r in got] == [0, 1, None]
    assert [r.prediction_lead_seconds for r in got] == [8.0, 12.0, None]


def test_strict_threshold(spark):
    got = labelled(spark, [(0, 4.0), (10, 2.999), (20, 3.0), (30, 3.001)])
    assert [r.future_poor_qoe for r in got] == [1, 0, 0, None]


def test_label_does_not_cross_sessions(spark):
    got = labelled(spark, [(0, 4.0), (10, 2.0), (100, 1.0), (110, 4.5)])
    assert [r.future_mos for r in got] == [2.0, None, 4.5, None]


def test_horizon_two(spark):
    rows = [(0, 4.5), (10, 4.0), (20, 2.0), (100, 2.0), (108, 2.5), (116, 4.5)]
    got = labelled(spark, rows, horizon=2)
    assert [r.future_poor_qoe for r in got] == [1, None, None, 0, None, None]
    assert [r.prediction_lead_seconds for r in got] == [20.0, None, None, 16.0, None, None]


def session_rows(spark):
    rows = [
        (1, 10, 4000, 7, at(8 * i), m, t, p, 48 + i / 10000, 2 + i / 10000)
        for i, (t, m, p) in enumerate([(2.0, 2.0, 20.0), (4.0, 3.0, 10.0), (8.0, 4.0, 0.0)])
    ]
    schema = SCHEMA + ", throughput_mbps double, plr_percent double, latitude double, longitude double"
    return spark.createDataFrame(rows, schema)


def test_features_use_the_past(spark):
    df = sessions.label(session_rows(spark))
    got = features.add_features(df).orderBy("timestamp").collect()
    assert [r.throughput_lag1 for r in got] == [None, 2.0, 4.0]
    assert [r.throughput_past_mean_3 for r in got] == [None, 2.0, 3.0]
    assert got[0].throughput_to_bitrate_ratio == 0.5 and got[2].throughput_to_bitrate_ratio == 2.0
    assert [r.throughput_past_std_5 for r in got][:2] == [None, None]
    assert [r.session_step for r in got] == [0, 1, 2]
    assert [r.capacity_insufficient for r in got] == [1, 0, 0]
    assert got[1].movement_distance_km == pytest.approx(0.01336, abs=1e-4)


def test_future_columns_are_refused(spark):
    with pytest.raises(ValueError, match="retrospective"):
        features.select_features(session_rows(spark), ["current_mos", "future_mos"])
    with pytest.raises(ValueError, match="missing"):
        features.select_features(session_rows(spark), ["absent"])


def split_frame(spark, n=10):
    rows = [(at(10 * i), at(10 * (i + 1)) if i < n - 1 else None, i % 2 if i < n - 1 else None) for i in range(n)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, future_timestamp timestamp_ntz, future_poor_qoe int")


def micros(seconds):
    return int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6) + seconds * 10**6


def test_split_boundaries(spark):
    df = split_frame(spark)
    b = splits.boundaries(df)
    assert (b.train_end, b.validation_end) == (micros(60), micros(80))
    sizes = {r.split: r["count"] for r in splits.assign_split(df, b).groupBy("split").count().collect()}
    assert sizes == {"train": 6, "validation": 2, "test": 2}
    # Several ranges give the same cut points.
    assert splits.boundaries(df, rows_per_range=3) == b


def test_crossing_labels_are_removed(spark):
    df = split_frame(spark)
    b = splits.boundaries(df)
    assigned = splits.assign_split(df, b)
    kept = splits.remove_crossing_targets(assigned, b)
    assert kept.count() == 7
    r = splits.removal_counts(assigned, b).first()
    assert (r.terminal_rows, r.train_crossing_rows, r.validation_crossing_rows) == (1, 1, 1)
    splits.check_split_order(kept)
    with pytest.raises(ValueError, match="every split"):
        splits.check_split_order(kept.where("split <> 'test'"))


def test_validation_halves(spark):
    rows = [(at(10 * i), at(10 * i + 5), 1, n) for i, n in enumerate("abcdef")]
    rows[2] = (at(20), at(35), 1, "crossing")
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, future_timestamp timestamp_ntz, future_poor_qoe int, n string")
    fit, select = splits.halve_validation(df)
    assert sorted(r.n for r in fit.collect()) == ["a", "b"]
    assert sorted(r.n for r in select.collect()) == ["d", "e", "f"]
    with pytest.raises(ValueError):
        splits.halve_validation(df.limit(1))


@pytest.mark.parametrize("bad", [dict(train=0), dict(train=0.9, validation=0.1)])
def test_split_params(bad):
    with pytest.raises(ValueError):
        SplitParams(**bad)


def compare(left, right):
    """Equal as bags of rows, in one job."""
    sides = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(-1)))
    balance = sides.groupBy(*left.columns).agg(F.sum("side").alias("balance"))
    r = balance.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("balance") != 0).alias("bad")).first()
    assert r.n > 0 and r.bad == 0


def rounded(df):
    doubles = {c: F.round(c, 9) for c, t in df.dtypes if t == "double"}
    return df.withColumns(doubles)


def test_sliced_windows_equal_plain_ones(spark, sf_dir):
    """Hot trajectories cut into many slices give the rows of the plain windows."""
    obs = views.observations(spark, sf_dir)
    # One user holds half of all rows.
    obs = obs.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, 1).otherwise(F.col("user_id")).cast("long"))
    obs = obs.withColumn("base_station", F.col("user_id") % 4 + 1).withColumn("prb", 5 * (F.col("user_id") % 8 + 1))
    for gap in (7200.0, 1e9):
        params = SessionParams(gap_seconds=gap)
        hot = sessions.hot_trajectories(obs, hot_rows=150)
        assert hot is not None and hot.rows > 1500
        frame = ordered(obs, TRAJECTORY, ["timestamp"], hot, before=1)
        assert frame.sliced and frame.df.select("__slice").distinct().count() > 10
        plain = features.add_features(sessions.label(obs, params))
        cut = features.add_features(sessions.label(obs, params, hot), hot)
        compare(rounded(plain), rounded(cut.select(plain.columns)))
    p = plain.withColumn("p", views.closed_form_probability())
    compare(
        rounded(features.prediction_stability(p, "p")), rounded(features.prediction_stability(p, "p", hot))
    )
    compare(
        sessions.history(plain, ["event_id"]).select("event_id", "bitrate_kbps", "history"),
        sessions.history(plain, ["event_id"], hot).select("event_id", "bitrate_kbps", "history"),
    )


@pytest.mark.parametrize("gap, horizon", [(7200.0, 1), (1e9, 2)])
def test_one_layout_for_the_whole_chain(spark, sf_dir, monkeypatch, gap, horizon):
    """One key holds half of all rows: sessions, labels, features, a filter and stability from one cut."""
    obs = views.observations(spark, sf_dir)
    obs = obs.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, 1).otherwise(F.col("user_id")).cast("long"))
    obs = obs.withColumn("base_station", F.col("user_id") % 4 + 1).withColumn("prb", 5 * (F.col("user_id") % 8 + 1))
    params = SessionParams(gap_seconds=gap, horizon=horizon)
    hot = find_hot_keys(obs.where("bitrate_kbps = 2000"), ["base_station", "prb", "user_id"], 150)
    bounds = splits.boundaries(obs.select("timestamp"))

    def chain(df):
        df = features.add_features(sessions.label(df, params))
        df = splits.remove_crossing_targets(splits.assign_split(df, bounds), bounds)
        return features.prediction_stability(df.withColumn("p", views.closed_form_probability()), "p")

    made = []
    kind = type(obs)
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: made.append(1) or real(self, *a, **k))
    cut = slices.close(chain(sessions.lay_out(obs, hot, 5 + 2 * horizon, horizon)))
    assert len(made) == 1
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    # The rows of other keys, and one summary a slice; the summary's own branch of the other keys is empty.
    joins = [plan.count(f"Join {k}") for k in ("LeftAnti", "LeftSemi", "LeftOuter")]
    assert joins[1:] == [0, 1] and joins[0] - plan.count("LocalRelation <empty>") <= 1
    plain = chain(obs)
    assert cut.columns == plain.columns
    compare(rounded(plain), rounded(cut))


def test_sliced_horizon(spark):
    rows = [(10 * i, 1.0 + i % 5) for i in range(60)]
    df = trajectory(spark, rows)
    hot = sessions.hot_trajectories(df, hot_rows=5)
    for horizon in (1, 7):
        params = SessionParams(horizon=horizon)
        compare(sessions.label(df, params), sessions.label(df, params, hot))


def test_no_hot_keys(spark):
    assert find_hot_keys(trajectory(spark, [(0, 1.0), (1, 1.0)]), TRAJECTORY, 2) is None


def test_row_order_and_partitioning_do_not_matter(spark, sf_dir):
    obs = views.observations(spark, sf_dir)
    one = features.add_features(sessions.label(obs.coalesce(1), views.SESSIONS))
    many = features.add_features(sessions.label(obs.orderBy(F.rand(3)).repartition(7), views.SESSIONS))
    compare(rounded(one), rounded(many))


@pytest.mark.parametrize("by_user", [False, True])
def test_one_shuffle_for_session_work(spark, sf_dir, by_user):
    """Labels, features and stability share the trajectory shuffle."""
    obs = views.observations(spark, sf_dir, by_user=by_user)
    df = features.add_features(sessions.label(obs, views.SESSIONS))
    df = features.prediction_stability(df.withColumn("p", views.closed_form_probability()), "p")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("files_per_batch", [1, 10])
def test_streamed_sessions_lose_nothing(spark, tmp_path, files_per_batch):
    """Rows of several users, out of order over the files: every session comes, open ones too."""
    from steadycast.streaming import replay as online
    from steadycast.streaming.runner import read_stream, run_available

    times = [(1, 100), (2, 5000), (3, 6000), (4, 7000), (5, 200), (6, 9000), (1, 110), (1, 400), (1, 50)]
    for user, t in times:
        row = [(1, 10, 4000, user, t * 1_000_000, float(t % 5))]
        df = spark.createDataFrame(row, "base_station long, prb long, bitrate_kbps long, user_id long, ts_us long, current_mos double")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), "*.parquet", max_files=files_per_batch)
    updates = run_available(online.session_aggregates_stream(stream, SessionParams(gap_seconds=60.0)), "update")
    got = {(r.user_id, r.session_number): (r.start_us // 10**6, r.end_us // 10**6, r.rows, r.open) for r in online.latest_sessions(updates).collect()}
    late = updates.where("late").groupBy().sum("rows").first()[0] or 0
    assert {k: v for k, v in got.items() if k[0] > 1} == {
        (u, 1): (t, t, 1, True) for u, t in times if u > 1
    }
    first = (100, 110, 2, False) if files_per_batch == 1 else (50, 110, 3, False)
    assert got[1, 1] == first and got[1, 2] == (400, 400, 1, True)
    assert late == (1 if files_per_batch == 1 else 0)
    assert sum(v[2] for v in got.values()) + late == len(times)
