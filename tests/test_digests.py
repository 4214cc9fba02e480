"""Tables compared by digests of buckets against the plain comparison."""

import re

import pytest
from pyspark.sql import functions as F

from steadycast.functions import text
from steadycast.operators import digests, lineage, reconcile

KEYS, COLUMNS = ["k", "part"], ["a", "b", "c"]
SCHEMA = "k long, part string, a string, b string, c double"
TREE = digests.Tree(outer=4, inner=8, files=2)


def base(n=400):
    return [(i if i % 50 else None, f"p{i % 3}", f"a{i}" if i % 7 else None, None if i % 5 else "b", float(i)) for i in range(n)]


def both(spark, tmp_path, left, right):
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (left, right)]
    paths = [str(tmp_path / side) for side in ("left", "right")]
    for frame, path in zip(frames, paths):
        digests.store(frame.repartition(3), path, KEYS, COLUMNS, TREE)
    plain = reconcile.stored_versus_recomputed(*frames, KEYS, COLUMNS).first()
    return digests.compare(spark, *paths, KEYS, COLUMNS), plain


def changed(rows, at, **new):
    names = ("k", "part", "a", "b", "c")
    return [tuple(new.get(n, v) for n, v in zip(names, r)) if i == at else r for i, r in enumerate(rows)]


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r,
        lambda r: list(reversed(r)),
        lambda r: changed(r, 8, c=0.25),
        lambda r: changed(r, 8, a=None, b="a8"),  # a null and a value trade places
        lambda r: r[:-1],
        lambda r: r + [(9000, "x", None, None, None)],
        lambda r: r + r[5:9] * 3,
        lambda r: [],
        lambda r: changed(changed(r, 3, a="x"), 301, c=None),
    ],
)
def test_equals_plain_comparison(spark, tmp_path, change):
    got, plain = both(spark, tmp_path, base(), change(base()))
    assert got.summary.first() == plain


def test_repeated_rows_on_both_sides_are_counted(spark, tmp_path):
    rows = base() + base()[:20]
    got, plain = both(spark, tmp_path, rows, changed(rows, 200, a="new"))
    assert got.summary.first() == plain and plain.repeated > 0


def test_empty_tables_are_equal(spark, tmp_path):
    got, plain = both(spark, tmp_path, [], [])
    assert got.summary.first() == plain


def test_only_unlike_buckets_are_read(spark, tmp_path):
    got, _ = both(spark, tmp_path, base(), changed(base(), 8, c=0.25))
    (bucket,) = got.buckets.collect()
    assert got.stored.count() == bucket.stored_rows == bucket.rebuilt_rows < 60
    plan = got.stored._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*outer_bucket#\d+ = {bucket.outer_bucket}\)", plan)


@pytest.mark.parametrize(
    "number, digits",
    [("5.", "5"), ("5.0", "5"), ("-0.0", "0"), ("007.50", "7.5"), ("𝟓", "5"), ("٣.٥٠", "3.5"), ("100", "100"), ("0.", "0"), ("", "")],
)
def test_canonical_digits(spark, number, digits):
    assert spark.range(1).select(text.exact_number(F.lit(number))).first()[0] == digits


def test_manifest_tells_folders_apart(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.txt").write_text(folder)
    files = {r.file: r.bytes for r in lineage.file_manifest(spark, f"{tmp_path}/").collect()}
    assert files == {"x/part.txt": 1, "y/part.txt": 1}
