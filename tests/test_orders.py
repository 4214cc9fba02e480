"""Stored order without a sort, numbers in ranges, and forests of weighted bootstraps."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler

from steadycast.operators import bagging, ranks
from steadycast.operators.sortedness import sortedness
from steadycast.params import ModelParams

NAN = float("nan")
SCHEMA = "a double, b string"


def stored(spark, path, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return path


@pytest.mark.parametrize(
    "files, breaks",
    [
        ([[(1.0, "a"), (1.0, "b"), (2.0, "a")], [(2.0, "a"), (3.0, None)]], 0),
        ([[(1.0, "b"), (1.0, "a"), (2.0, "a")], [(2.0, None), (3.0, "x")]], 2),
        ([[(None, "z"), (-1.0, None), (-1.0, "a"), (NAN, "a"), (NAN, "b")]], 0),
        ([[(NAN, "a"), (5.0, "a"), (None, "a"), (None, None)]], 3),
        ([[(None, None)] * 4], 0),
        ([[]], 0),
    ],
)
def test_sortedness(spark, tmp_path, files, breaks):
    r = sortedness(spark, stored(spark, str(tmp_path / "t"), *files), ["a", "b"]).first()
    assert (r.rows, r.breaks, r.sorted) == (sum(map(len, files)), breaks, breaks == 0)


def test_many_batches_of_a_file(spark, tmp_path):
    values = np.arange(30_000) // 3
    values[[12_345, 20_000]] = 0
    spark.createDataFrame([(float(v), "x") for v in values], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "t"))
    r = sortedness(spark, str(tmp_path / "t"), ["a"]).first()
    assert r.files == 1 and r.breaks == int((np.diff(values) < 0).sum()) == 2
    plan = sortedness(spark, str(tmp_path / "t"), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("rows_per_range", [7, 10**6])
def test_numbers_are_consecutive(spark, rows_per_range):
    rows = [(int(x), f"k{x % 5}") for x in np.random.default_rng(2).permutation(300)]
    df = spark.createDataFrame(rows, "x long, k string")
    got = ranks.numbered(df, ["k", "x"], "n", rows_per_range=rows_per_range).orderBy("n").collect()
    assert [(r.k, r.x) for r in got] == sorted((k, x) for x, k in rows) and [r.n for r in got] == list(range(1, 301))
    assert ranks.numbered(df.limit(0), ["k", "x"], "n").collect() == []


def test_draws_are_poisson():
    limits = np.array(bagging.thresholds(0.5)) / 2**32
    assert limits[:3] == pytest.approx(np.cumsum([math.exp(-0.5) * 0.5**k / math.factorial(k) for k in range(3)]), abs=1e-9)
    assert limits[-1] == 1.0


def test_forest_of_own_weights(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.random((1500, 3))
    y = (x[:, 0] + 0.2 * rng.random(1500) > 0.9).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "i long, a double, b double, c double, label double")
    params = ModelParams(trees=6, depth=4, leaf=5, own_weights=True)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="__features").transform(df)
    drawn = bagging.with_draws(vectors, params, ["i"]).cache()
    k = np.array([r[0] for r in drawn.select(bagging.DRAWS).orderBy("i").collect()])
    assert k.shape == (1500, 6) and abs(k.mean() - params.sample_share) < 0.03 and len({tuple(c) for c in k.T}) == 6
    again = bagging.with_draws(vectors.repartition(7), params, ["i"]).orderBy("i")
    assert (np.array([r[0] for r in again.select(bagging.DRAWS).collect()]) == k).all()
    for r in bagging.bootstrap_weights(drawn, "label", 6).collect():
        rows = k[y == r.label, r.tree].sum()
        assert (r.rows, r.weight) == (rows, pytest.approx(k[:, r.tree].sum() / (2 * rows)))
    model = bagging.fit_trees(drawn, params)
    assert model.getNumTrees == 6 and len({t.toDebugString for t in model.trees}) == 6
    model.save(str(tmp_path / "m"))
    loaded = RandomForestClassificationModel.load(str(tmp_path / "m"))
    a, b = (m.transform(drawn).orderBy("i").select("__p", "__d").collect() for m in (model, loaded))
    assert a == b and np.mean([r["__d"] for r in a] == y) > 0.9
    with pytest.raises(ValueError, match="lacks a class"):
        bagging.fit_trees(drawn.where("label = 0"), params)
