"""Models and calibrators against direct solutions, and the stream against disorder."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadycast.operators import bagging, calibration, models
from steadycast.params import ModelParams
from steadycast.plans import forecast, views
from steadycast.streaming import replay
from steadycast.streaming.runner import read_stream, run_available


def newton(x, y, w, penalty=1.0):
    """Minimum of 0.5 |b|^2 + sum w * loss, intercept not penalised."""
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        gradient = a.T @ (w * (p - y)) + ridge @ b
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + ridge
        b -= np.linalg.solve(hessian, gradient)
    return b


def test_sigmoid_is_the_penalised_fit(spark):
    rng = np.random.default_rng(4)
    p = rng.random(200)
    y = (rng.random(200) < p).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "p double, y double")
    slope, intercept = calibration.fit_sigmoid(df, "p", "y").model
    want = newton(p[:, None], y, np.ones(200))
    assert (slope, intercept) == pytest.approx(tuple(want), abs=1e-5)


def test_isotonic_pools_interpolates_and_clips(spark):
    data = [(0.1, 0), (0.2, 1), (0.3, 0), (0.8, 1), (0.8, 1), (0.9, 1)]
    df = spark.createDataFrame(data, "p double, y int")
    fitted = calibration.fit_isotonic(df, "p", "y")
    at = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.15, 0.25, 0.55, 0.8, 1.0)], "p double")
    got = [r.c for r in fitted.apply(at, "p", "c").orderBy("p").collect()]
    assert got == pytest.approx([0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0])


def test_calibration_bounds(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "p double, y int")
    for method in (calibration.SIGMOID, calibration.ISOTONIC):
        out = calibration.fit_calibrator(method, df, "p", "y").apply(df, "p", "c")
        assert out.where("c < 0 or c > 1 or c is null").isEmpty()
    with pytest.raises(ValueError):
        calibration.fit_calibrator("other", df, "p", "y")


def test_weights_and_modes(spark):
    df = spark.createDataFrame([(1, "b"), (0, "a"), (0, "b"), (0, "a"), (None, None)], "y int, r string")
    got = {r.label: r.weight for r in models.class_weights(df.where("y is not null"), "y").collect()}
    assert got == {0: pytest.approx(4 / 6), 1: 2.0}
    assert models.most_frequent(df, "r").first().r == "a"
    with pytest.raises(ValueError, match="both classes"):
        models.with_weights(df.where("y = 0"), "y")


def test_whole_job(spark, sf_dir):
    params = forecast.ForecastParams(
        sessions=views.SESSIONS, models=ModelParams(trees=5, depth=4, fit_partitions=2, max_iter=50)
    )
    job = forecast.run(views.observations(spark, sf_dir), params)
    assert set(job.fitted.selection) == {forecast.LOGISTIC, forecast.FOREST}
    assert job.fitted.grid.metrics.count() == 4 and job.fitted.grid.curves.count() == 4 * 91
    t = job.trusted
    assert t.where("split <> 'test'").isEmpty() if "split" in t.columns else True
    bad = t.where("calibrated_probability not between 0 and 1 or trust_score not between 0 and 1")
    assert bad.isEmpty() and t.count() > 300
    assert t.where(F.col("abstain") != (F.col("trust_score") < job.fitted.abstention)).isEmpty()
    got = forecast.compare_models(t, job.fitted).collect()
    assert len(got) == 3 and len({r.observations for r in got}) == 1
    train = forecast._table(spark, job.feature_path, "train")
    importance = models.feature_importance(job.fitted.models[forecast.FOREST], train)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert models.top_features(importance, 3).count() == 3


def test_fit_makes_one_pass_for_what_both_models_need(spark, sf_dir, monkeypatch):
    """Medians are found once, node ids are kept, scored rows are dealt out; the forest stays the same."""
    params = ModelParams(trees=4, depth=5, fit_partitions=3, max_iter=20)
    found, alone = [], models.medians
    monkeypatch.setattr(models, "medians", lambda *a, **k: found.append(a[1]) or alone(*a, **k))
    job = forecast.run(views.observations(spark, sf_dir), forecast.ForecastParams(sessions=views.SESSIONS, models=params))
    assert len(found) == 1
    forest = job.fitted.models[forecast.FOREST].stages[-1]
    assert forest.getOrDefault("cacheNodeIds")
    whole = models.forest_stages
    monkeypatch.setattr(models, "forest_stages", lambda *a: [*(s := whole(*a))[:-1], s[-1].copy().setCacheNodeIds(False)])
    train = forecast._table(spark, job.feature_path, "train").where(F.col(models.TARGET).isNotNull())
    plain = models.fit_forest(train, params).stages[-1]
    trees = [m.toDebugString.split("\n", 1)[1] for m in (forest, plain)]
    assert not plain.getOrDefault("cacheNodeIds") and trees[0].replace(forest.uid, "") == trees[1].replace(plain.uid, "")
    rows = spark.range(90).select(*[F.col("id").alias(k) for k in models.ROW_KEY]).coalesce(1)
    out = forecast.spread(rows, rows_per_task=30)
    assert out.rdd.getNumPartitions() == 3 and sorted(out.collect()) == sorted(rows.collect())
    assert forecast.spread(rows.limit(0)).count() == 0


def stream_input(spark, tmp_path, order):
    """Six interleaved rows of two sessions, written as one file per batch in ``order``."""
    rows = [(u, 4 * i, t, m, p) for i, (u, t, m, p) in enumerate(
        [(1, 2.0, 2.0, 20.0), (2, 9.0, 4.5, 1.0), (1, 4.0, 3.0, 10.0), (2, 6.0, 3.5, 5.0), (1, 8.0, 4.0, 0.0), (2, 3.0, 2.5, 12.0)]
    )]
    data = [(i, 1, 10, 4000, u, s * 10**6, t, m, p, 48.0, 2.0) for i, (u, s, t, m, p) in enumerate(rows)]
    schema = (
        "event_id long, base_station long, prb long, bitrate_kbps long, user_id long, ts_us long, throughput_mbps double, "
        "current_mos double, plr_percent double, latitude double, longitude double"
    )
    import os

    for n, batch in enumerate(order):
        target = str(tmp_path / f"b{n}")
        spark.createDataFrame([data[i] for i in batch], schema).coalesce(1).write.parquet(target)
        part = next((tmp_path / f"b{n}").glob("part*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        os.link(part, tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return read_stream(spark, str(tmp_path / "in"), "*.parquet", max_files=1)


def test_stream_in_batches(spark, tmp_path):
    """State carries over micro-batches; order inside a batch does not matter."""
    stream = stream_input(spark, tmp_path, [[2, 0, 1], [3], [5, 4]])
    got = {r.event_id: r for r in run_available(replay.online_features(stream)).collect()}
    assert len(got) == 6 and not any(r.late for r in got.values())
    assert [got[i].session_step for i in (0, 2, 4)] == [0, 1, 2]
    assert [got[i].throughput_lag1 for i in (0, 2, 4)] == [None, 2.0, 4.0]
    assert got[4].throughput_past_mean_3 == 3.0 and got[5].mos_past_mean_3 == 4.0
    assert got[4].elapsed_session_seconds == 16.0 and got[4].gap_seconds == 8.0


def test_late_rows_are_given_back(spark, tmp_path):
    stream = stream_input(spark, tmp_path, [[2, 1], [0, 3], [4, 5]])
    out = run_available(replay.online_features(stream))
    assert [r.event_id for r in out.where("late").collect()] == [0]
    r = replay.late_rows(out).first()
    assert (r.rows, r.late_rows) == (6, 1)


def test_replay_keeps_the_last_five(spark, tmp_path):
    stream = stream_input(spark, tmp_path, [[0, 1, 2], [3, 4, 5]])
    stream = stream.withColumns({"session_id": F.col("user_id").cast("string"), "future_mos": F.lit(9.0)})

    def score(df):
        assert "future_mos" not in df.columns
        return df.withColumn("probability", F.lit(1.0) - F.col("current_mos") / 5)

    got = {r.event_id: r for r in run_available(replay.replay(stream, score, size=2)).collect()}
    assert got[4].history == [2, 4] and got[0].history == [0] and got[0].prediction == 1


def test_draws_are_generated_code(spark):
    """The same numbers as from parsed digits, found without a lambda or a conversion of texts."""
    df = spark.range(300).localCheckpoint()
    out = df.select("id", bagging.draws(6, 42, 0.5, [F.col("id")]).alias("d"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in plan and "lambda" not in plan and "conv(" not in plan
    bounds = bagging.thresholds(0.5)
    for row in out.collect():
        for t, drawn in enumerate(row.d):
            digest = hashlib.md5(f"{row.id}|42:{t // 4}".encode()).hexdigest()
            bits = int(digest[8 * (t % 4) : 8 * (t % 4) + 8], 16)
            assert drawn == sum(b <= bits for b in bounds)


def stream_of(spark, tmp_path, batches):
    """One file per micro-batch; a row is (event_id, user_id, bitrate, seconds, mos)."""
    import os

    schema = (
        "event_id long, base_station long, prb long, bitrate_kbps long, user_id long, ts_us long, throughput_mbps double, "
        "current_mos double, plr_percent double, latitude double, longitude double"
    )
    (tmp_path / "in").mkdir()
    for n, batch in enumerate(batches):
        data = [(e, u and u % 4, 10, b, u, s * 10**6, m * 2, m, 1.0 * e, 48.0, 2.0) for e, u, b, s, m in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        target = tmp_path / "in" / f"{n}.parquet"
        os.link(next((tmp_path / f"b{n}").glob("part*.parquet")), target)
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    return read_stream(spark, str(tmp_path / "in"), "*.parquet", max_files=1)


# Users 0 and null and two bitrates; late rows, gaps of more than 30 s, and trajectories that miss a batch.
BATCHES = [
    [(1, 1, 2000, 0, 2.0), (2, None, 2000, 5, 3.0), (3, 1, 4000, 0, 4.0), (4, 0, 2000, 5, 1.0), (5, 1, 2000, 50, 2.5), (6, 1, 2000, 60, 5.0)],
    [(7, None, 2000, 9, 4.0), (8, 1, 2000, 55, 1.5), (9, 1, 2000, 70, 3.5), (10, 2, 2000, 7, 2.0), (11, 0, 2000, 90, 3.0)],
    [(12, 0, 2000, 8, 2.0), (13, None, 2000, 11, 2.0), (14, 1, 2000, 200, 4.5), (15, 1, 2000, 210, 3.0), (16, 1, 4000, 1, 1.0)],
]


def test_a_bucket_of_many_trajectories_gives_what_each_alone_gives(spark, tmp_path):
    stream = stream_of(spark, tmp_path, BATCHES)
    together = run_available(replay.online_features(stream, buckets=1)).collect()
    apart = run_available(replay.online_features(stream, buckets=10**9)).collect()
    assert sorted(map(repr, together)) == sorted(map(repr, apart)) and len(together) == 16
    got = {r.event_id: r for r in together}
    assert [e for e in got if got[e].late] and {e for e in got if got[e].late} == {8, 12}
    assert (got[9].session_number, got[9].session_step, got[9].mos_lag1, got[9].gap_seconds) == (2, 2, 5.0, 10.0)
    assert got[9].mos_past_mean_3 == 3.75 and got[14].session_number == 3 and got[14].mos_lag1 is None
    assert got[13].user_id is None and got[13].mos_past_mean_3 == 3.5 and got[4].user_id == 0 and got[11].session_number == 2
    assert got[16].bitrate_kbps == 4000 and got[16].mos_lag1 == 4.0


def test_sessions_of_a_bucket_of_many_trajectories(spark, tmp_path):
    stream = stream_of(spark, tmp_path, BATCHES)
    together = run_available(replay.session_aggregates_stream(stream, buckets=1), "update")
    apart = run_available(replay.session_aggregates_stream(stream, buckets=10**9), "update")
    assert sorted(map(repr, together.collect())) == sorted(map(repr, apart.collect()))
    assert [(r.rows, r.start_us) for r in together.where("late").orderBy("start_us").collect()] == [(1, 8 * 10**6), (1, 55 * 10**6)]
    last = {(r.user_id, r.bitrate_kbps, r.session_number): r for r in replay.latest_sessions(together).collect()}
    assert {k: v.rows for k, v in last.items()} == {
        (1, 2000, 1): 1, (1, 2000, 2): 3, (1, 2000, 3): 2, (1, 4000, 1): 2, (None, 2000, 1): 3, (0, 2000, 1): 1, (0, 2000, 2): 1, (2, 2000, 1): 1,
    }
    assert not last[1, 2000, 2].open and last[1, 2000, 3].open and abs(last[1, 2000, 2].mean_mos - 11 / 3) < 1e-9


def test_replay_of_a_bucket_of_many_sessions(spark, tmp_path):
    from pyspark.sql import functions as F

    stream = stream_of(spark, tmp_path, BATCHES).withColumn("session_id", F.col("user_id").cast("string"))
    score = lambda df: df.withColumn("probability", F.lit(0.5))
    together = run_available(replay.replay(stream, score, size=2, buckets=1)).collect()
    apart = run_available(replay.replay(stream, score, size=2, buckets=10**9)).collect()
    assert sorted(map(repr, together)) == sorted(map(repr, apart))
    got = {r.event_id: r for r in together}
    assert got[13].session_id is None and got[13].history == [7, 13] and got[8].late and got[9].history == [6, 9]
    assert got[12].history is None and got[11].history == [4, 11]


def test_state_is_read_once_a_bucket(spark, tmp_path):
    """Calls of the handlers do not grow with the number of trajectories."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(*[F.col("id").alias(k) for k in replay.TRAJECTORY])
    assert replay._bucketed(rows, [], 16).select(replay.BUCKET).distinct().count() == 16
