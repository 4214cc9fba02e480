"""Metrics, ranks, trust and samples against hand-computed values and brute force."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadycast.functions import scalar
from steadycast.operators import metrics, profiles, ranks, sampling
from steadycast.params import TrustPolicy


def brute(y, d, p):
    y, d, p = np.asarray(y), np.asarray(d), np.asarray(p, dtype=float)
    order = sorted(set(p), reverse=True)
    ap, recall = 0.0, 0.0
    for t in order:
        hit = p >= t
        r = y[hit].sum() / max(y.sum(), 1)
        ap += (r - recall) * (y[hit].sum() / hit.sum())
        recall = r
    pos, neg = p[y == 1], p[y == 0]
    auc = None
    if len(pos) and len(neg):
        auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in product(pos, neg)])
    edges = np.linspace(0, 1, 11)[1:-1]
    bins = np.digitize(p, edges, right=True)
    ece = sum(abs(y[bins == b].mean() - p[bins == b].mean()) * (bins == b).mean() for b in set(bins))
    return dict(
        pr_auc=ap, roc_auc=auc, expected_calibration_error=ece, brier_score=np.mean((p - y) ** 2),
        accuracy=np.mean(y == d), true_positives=int(((y == 1) & (d == 1)).sum()),
    )


def rows(n, seed, places):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = round(rng.random(), places)
        out.append((i % 3, int(rng.random() < p), p, int(p >= 0.5)))
    return out


@pytest.mark.parametrize("places", [1, 4])
@pytest.mark.parametrize("per_range", [10**6, 7])
def test_binary_metrics_match_brute_force(spark, places, per_range):
    data = rows(400, 5, places)
    df = spark.createDataFrame(data, "g int, y int, p double, d int")
    got = {
        r.g: r for r in metrics.binary_metrics(df, "y", "d", "p", ["g"], rows_per_range=per_range).collect()
    }
    for g in range(3):
        part = [r for r in data if r[0] == g]
        want = brute([r[1] for r in part], [r[3] for r in part], [r[2] for r in part])
        for name, value in want.items():
            assert got[g][name] == pytest.approx(value, abs=1e-12), name
        assert got[g].observations == len(part)


def test_single_class_group(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.7)], "y int, d int, p double")
    r = metrics.binary_metrics(df, "y", "d", "p").first()
    assert r.roc_auc is None and r.pr_auc == 0 and r.precision == 0 and r.false_alarm_rate == 0.5


def test_published_evaluation_frame(spark):
    df = spark.createDataFrame(
        [(0, 0, 0.1, "high", 0.9, False), (0, 1, 0.7, "low", 0.4, True), (1, 1, 0.8, "high", 0.95, False),
         (1, 1, 0.9, "medium", 0.7, False)],
        "y int, d int, p double, trust_level string, trust_score double, abstain boolean",
    )
    r = metrics.binary_metrics(df, "y", "d", "p").first()
    assert (r.true_negatives, r.false_positives, r.false_negatives, r.true_positives) == (1, 1, 0, 2)
    levels = metrics.trust_level_metrics(df, "y", "d", "p").collect()
    assert [x.trust_level for x in levels] == ["high", "medium", "low"]
    assert levels[0].coverage == 0.5 and levels[2].abstention_rate == 1.0
    s = metrics.selective_summary(df, "y", "d").first()
    assert s.accepted_accuracy == 1.0 and s.coverage == 0.75


def test_bins_are_right_closed(spark):
    edges = [0.0, 0.1, 0.2, 0.30000000000000004, 0.3, 0.7000000000000001, 1.0]
    df = spark.createDataFrame([(e,) for e in edges], "p double")
    got = [r.b for r in df.select("p", scalar.right_closed_bin(F.col("p")).alias("b")).collect()]
    want = (np.digitize(edges, np.linspace(0, 1, 11)[1:-1], right=True) + 1).tolist()
    assert got == want


def test_thresholds_are_the_doubles_of_the_range():
    assert metrics.THRESHOLDS == np.arange(0.05, 0.95 + 0.01, 0.01).tolist()


def test_threshold_sweep(spark):
    data = rows(300, 9, 2)
    df = spark.createDataFrame(data, "g int, y int, p double, d int")
    got = metrics.threshold_sweep(df, "y", "p").orderBy("threshold").collect()
    assert len(got) == 91
    y, p = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    for r, t in zip(got, metrics.THRESHOLDS):
        hit = p >= t
        tp = int(y[hit].sum())
        assert r.threshold == t
        assert r.precision == pytest.approx(tp / hit.sum() if hit.sum() else 0.0)
        assert r.recall == pytest.approx(tp / y.sum())
    best = metrics.best_threshold(metrics.threshold_sweep(df, "y", "p")).first()
    want = max(got, key=lambda r: (r.f1, r.precision, -r.threshold))
    assert best.threshold == want.threshold


def risk(spark, data, **options):
    df = spark.createDataFrame(data, "y int, d int, t double")
    return metrics.risk_coverage(df, "y", "d", "t", **options)


@pytest.mark.parametrize("per_range", [10**6, 2])
def test_risk_coverage(spark, per_range):
    tied = risk(spark, [(0, 1, 0.1), (1, 1, 0.2), (0, 0, 0.2), (1, 1, 0.3)], rows_per_range=per_range)
    got = tied.orderBy("abstention_threshold").collect()
    assert [(r.abstention_threshold, r.accepted_predictions, r.selective_risk) for r in got] == [
        (0.1, 4, 0.25), (0.2, 3, 0.0), (0.3, 1, 0.0)
    ]
    data = [(i % 2, 1 if i == 0 else i % 2, (i + 1) / 10) for i in range(10)]
    table = risk(spark, data, rows_per_range=per_range)
    best = metrics.select_abstention(table, 0.9).first()
    assert (best.abstention_threshold, best.accepted_predictions, best.selective_risk) == (0.2, 9, 0.0)
    assert metrics.annotate_risk_coverage(table, 0.2).where("selected").count() == 1


def test_trust_values(spark):
    df = spark.createDataFrame([(0.9,)], "p double")
    policy = TrustPolicy()
    score = scalar.configured_trust(
        scalar.probability_confidence(F.col("p"), 0.5), 0.8, 0.1, F.lit(0.5), policy
    )
    r = df.select(
        score.alias("s"), scalar.trust_level(score, 0.8, 0.55).alias("l"),
        scalar.abstains(score, 0.7, policy).alias("a"),
    ).first()
    assert r.s == pytest.approx(0.79) and r.l == "medium" and not r.a


def test_component_trust_values(spark):
    p = [0.1, 0.7, 0.8, 0.4, 0.9]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    parts = scalar.component_trust(
        F.col("p"), 0.8, 0.1, F.lit(1.0), F.lit(0.75), weights=(0.25, 0.25, 0.25, 0.25)
    )
    got = [r.component_trust for r in df.select(parts["component_trust"].alias("component_trust")).collect()]
    confidence = [0.8, 0.4, 0.6, 0.2, 0.8]
    want = [0.25 * (c + 0.7 * 0.8 + 0.3 * 0.9 + 1.0 + 0.75) for c in confidence]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_confidence_refuses_bad_probabilities(spark, bad):
    df = spark.createDataFrame([(bad,)], "p double")
    with pytest.raises(Exception, match="finite"):
        df.select(scalar.probability_confidence(F.col("p"), 0.5)).collect()
    with pytest.raises(ValueError):
        scalar.probability_confidence(F.lit(0.5), 1.0)


@pytest.mark.parametrize("per_range", [10**6, 11])
def test_exact_quantiles(spark, per_range):
    rng = random.Random(2)
    data = [(i % 4, None if i % 17 == 0 else round(rng.gauss(0, 3), 1)) for i in range(500)]
    df = spark.createDataFrame(data, "g int, v double")
    probs = {"p05": 0.05, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for r in ranks.exact_quantiles(df, "v", probs, ["g"], rows_per_range=per_range).collect():
        values = [v for g, v in data if g == r.g and v is not None]
        assert r["count"] == len(values)
        for n, q in probs.items():
            assert r[n] == pytest.approx(np.quantile(values, q))


def test_running_totals_use_ranges(spark):
    counts = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    got = ranks.running_totals(counts, "v", ["n"], rows_per_range=50, descending=True)
    assert got.where((F.col("cum_n") != 1000 - F.col("v")) | (F.col("tot_n") != 1000)).isEmpty()
    sizes = ranks.by_ranges(counts, "v", 50).groupBy("__range").count()
    assert sizes.count() == 20 and sizes.agg(F.max("count")).first()[0] <= 120


@pytest.mark.parametrize("per_range", [10**6, 1, 3])
def test_nan_and_null_do_not_depend_on_range_size(spark, per_range):
    nan = float("nan")
    df = spark.createDataFrame([(0.1,), (0.7,), (nan,), (None,), (0.7,), (0.2,)], "v double")
    r = ranks.exact_quantiles(df, "v", {"p0": 0.0, "p50": 0.5, "p75": 0.75}, rows_per_range=per_range).first()
    assert (r["count"], r.p0, r.p50, r.p75) == (5, 0.1, 0.7, 0.7)
    rows = [(0, 1, 0.1), (1, 1, 0.2), (0, 0, nan), (1, 1, 0.3)]
    whole = risk(spark, rows, rows_per_range=10**6).orderBy("abstention_threshold").collect()
    assert repr(risk(spark, rows, rows_per_range=per_range).orderBy("abstention_threshold").collect()) == repr(whole)


def test_review_sample_is_deterministic(spark):
    from datetime import datetime, timedelta

    data = []
    for i in range(36):
        data.append((f"s{i}", i, datetime(2024, 1, 1) + timedelta(seconds=i), i % 3 == 0, int(i % 3 == 1)))
    schema = "session_id string, user_id long, timestamp timestamp_ntz, abstain boolean, predicted_poor_qoe int"
    df = spark.createDataFrame(data, schema)
    one = sampling.review_sample(df, 1).select("category", "session_id").collect()
    two = sampling.review_sample(df.orderBy(F.rand(1)).repartition(5), 1).select("category", "session_id").collect()
    assert len(one) == 30 and sorted(one) == sorted(two)
    other = sampling.review_sample(df, 2).select("category", "session_id").collect()
    assert sorted(one) != sorted(other)
    with pytest.raises(ValueError, match="of 10 rows"):
        sampling.review_sample(df.where("not abstain or user_id < 5"), 1)


def test_lead_time_statistics_skip_text(spark):
    df = spark.createDataFrame([("5",), ("10",), ("x",), ("15",), (None,), ("20",)], "v string")
    r = profiles.lead_time_statistics(df, "v").first()
    assert (r["count"], r.minimum_seconds, r.median_seconds, r.maximum_seconds) == (4, 5.0, 12.5, 20.0)
