"""Distributed pooling against a plain one, at seams of every kind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadycast.operators import calibration, isotonic


def pooled(x, y):
    """Pool adjacent violators over sorted distinct scores; returns the value of each."""
    stack = []
    for v, n in zip(y, np.ones(len(y))):
        stack.append([v, n, 1])
        while len(stack) > 1 and stack[-2][0] / stack[-2][1] >= stack[-1][0] / stack[-1][1]:
            t, n, k = stack.pop()
            stack[-1] = [stack[-1][0] + t, stack[-1][1] + n, stack[-1][2] + k]
    return np.concatenate([[t / n] * k for t, n, k in stack])


RNG = np.random.default_rng(11)
X = np.sort(RNG.random(600))
CASES = {
    "calibrated": (RNG.random(600) < X).astype(float),
    "rising": (X > 0.5).astype(float),
    "reversed": (X < 0.5).astype(float),
    "constant": np.ones(600),
    "waves": ((X * 7) % 1 > 0.5).astype(float),
    "steep": X**3,
    "falling": -X,
}


@pytest.mark.parametrize("case, ranges, limit", [*((c, 9, 3) for c in CASES), ("calibrated", 1, 10**6), ("waves", 7, 10**6)])
def test_blocks_equal_plain_pooling(spark, case, ranges, limit):
    y = CASES[case]
    df = spark.createDataFrame(list(zip(X.tolist(), y.tolist())), "p double, y double")
    blocks = isotonic.fit_blocks(df, "p", "y", rows_per_range=-(-600 // ranges), candidates=limit).orderBy("low").toPandas()
    got = np.repeat(blocks.value.to_numpy(), blocks.weight.astype(int).to_numpy())
    assert got == pytest.approx(pooled(X, y), abs=1e-12)
    assert (blocks.low.to_numpy()[1:] > blocks.high.to_numpy()[:-1]).all() and blocks.weight.sum() == 600


def test_ties_nulls_and_odd_scores(spark):
    rows = [(0.5, 1), (0.5, 0), (0.5, 0), (0.2, 1), (None, 1), (0.1, None), (float("nan"), 1), (float("inf"), 0), (-0.0, 0), (0.0, 1)]
    df = spark.createDataFrame(rows * 3, "p double, y int")
    blocks = isotonic.fit_blocks(df, "p", "y", rows_per_range=2).orderBy("low").collect()
    assert [(b.low, b.high, round(b.value, 9), b.weight) for b in blocks[:2]] == [(0.0, float("inf"), round(3 / 7, 9), 21.0), pytest.approx((np.nan, np.nan, 1.0, 3.0), nan_ok=True)]
    assert isotonic.fit_blocks(df.limit(0), "p", "y").collect() == []
    with pytest.raises(ValueError):
        calibration.fit_isotonic(df.limit(0), "p", "y")


@pytest.mark.parametrize("rows_per_range", [50, 10**6])
def test_joined_line_equals_model(spark, rows_per_range):
    df = spark.createDataFrame(list(zip(X.tolist(), CASES["calibrated"].tolist())), "p double, y double")
    model = calibration.fit_isotonic(df, "p", "y")
    table = calibration.fit_isotonic(df, "p", "y", rows_per_range=80, corners=0)
    asked = [*RNG.random(300).tolist(), *X[::7].tolist(), *X[::7].tolist(), -1.0, 2.0, float(X[0]), float(X[-1])]
    at = spark.createDataFrame([(v, i) for i, v in enumerate(asked)], "p double, i int")
    want = [r.c for r in model.apply(at, "p", "c").orderBy("i").collect()]
    got = isotonic.interpolate(at, "p", table.model, "c", rows_per_range).orderBy("i").collect()
    assert [r.c for r in got] == pytest.approx(want, abs=1e-12)
    assert table.apply(at.withColumn("p", F.lit(None).cast("double")), "p", "c").where("c is not null").isEmpty()
