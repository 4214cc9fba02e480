"""Isotonic regression by distributed pooling of adjacent violators.

Scores are combined, dealt out by ranges and pooled to blocks of rising value inside each range.
Neighbouring groups of ranges are then merged in a tree. Two lists of rising blocks meet at a seam;
if the left one ends higher than the right one begins, exactly one block forms there: the left
blocks of at least its value and the right blocks of at most its value. With

    f(v) = sum over left blocks of value >= v and right blocks of value <= v of (total - v * weight),

which falls in v, that value is the root of f, so it is found with sums, of all seams at once, and
no task holds a list. Candidates are narrowed to a bounded number for each seam by 256 equal steps of v at a time.

Nulls in score or label are left out; NaN is the greatest score. The driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadycast.operators.ranks import RANGE, ROWS_PER_RANGE, by_ranges
from steadycast.session import shared_dir

CANDIDATES = 1_000_000
STEPS = 256
_BLOCK = f"{RANGE} int, low double, high double, total double, weight double"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool the sorted scores of one range: a stack of blocks of rising value."""
    part, stack = 0, []
    for batch in batches:
        if batch.num_rows:
            part = batch.column(0)[0].as_py()
        for x, total, weight in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            low = x
            while stack and stack[-1][2] * weight >= total * stack[-1][3]:
                low, _, t, w = stack.pop()
                total, weight = total + t, weight + w
            stack.append((low, x, total, weight))
    for start in range(0, len(stack), 1 << 16):
        some = stack[start : start + (1 << 16)]
        columns = [pa.array([part] * len(some), pa.int32()), *(pa.array(c, pa.float64()) for c in zip(*some))]
        yield pa.RecordBatch.from_arrays(columns, names=[RANGE, "low", "high", "total", "weight"])


def _left(width: int) -> Column:
    return F.floor(F.col(RANGE) / width) % 2 == 0


def _narrow(candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """Closer bounds of each seam's value, and the sums of what surely belongs to its block.

    ``bounds`` has (seam, below, above, sure_total, sure_weight, sure_low, sure_high).
    """
    step = (F.col("above") - F.col("below")) / STEPS
    own = candidates.join(bounds, "seam")
    bin_ = F.when(step > 0, F.least(F.floor((F.col("value") - F.col("below")) / step), F.lit(STEPS - 1))).otherwise(0)
    sums = own.groupBy("seam", bin_.alias("bin"), "left").agg(
        F.sum("total").alias("total"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    # 256 rows at most of each side of a seam.
    steps = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("k"))
    edge = F.col("below") + F.col("k") * step
    counted = F.when(F.col("left"), F.col("bin") >= F.col("k")).otherwise(F.col("bin") < F.col("k"))
    at = steps.join(sums, "seam").where(counted).groupBy("seam", "k", edge.alias("edge")).agg(F.sum("total").alias("t"), F.sum("weight").alias("w"))
    at = at.join(bounds.select("seam", "sure_total", "sure_weight"), "seam")
    excess = F.col("t") + F.col("sure_total") - F.col("edge") * (F.col("w") + F.col("sure_weight"))
    found = at.where(excess >= 0).groupBy("seam").agg(F.max("k").alias("k"))
    found = bounds.join(found, "seam", "left").withColumn("k", F.least(F.coalesce("k", F.lit(0)), F.lit(STEPS - 1)))
    sure = F.when(F.col("left"), F.col("bin") > F.col("k")).otherwise(F.col("bin") < F.col("k"))
    more = sums.join(found.select("seam", "k"), "seam").where(sure).groupBy("seam").agg(
        F.sum("total").alias("t"), F.sum("weight").alias("w"),
        F.min(F.when(F.col("left"), F.col("low"))).alias("l"), F.max(F.when(~F.col("left"), F.col("high"))).alias("h"),
    )
    return found.join(more, "seam", "left").select(
        "seam",
        edge.alias("below"),
        F.when(F.col("k") == STEPS - 1, F.col("above")).otherwise(F.col("below") + (F.col("k") + 1) * step).alias("above"),
        (F.col("sure_total") + F.coalesce("t", F.lit(0.0))).alias("sure_total"),
        (F.col("sure_weight") + F.coalesce("w", F.lit(0.0))).alias("sure_weight"),
        F.least("sure_low", "l").alias("sure_low"),
        F.greatest("sure_high", "h").alias("sure_high"),
    )


def _seams(blocks: DataFrame, width: int, limit: int) -> DataFrame:
    """The block that forms at each seam of groups of ``width`` ranges: (seam, low, high, total, weight)."""
    sided = blocks.withColumns(
        {"seam": F.floor(F.col(RANGE) / (2 * width)), "left": _left(width), "value": F.col("total") / F.col("weight")}
    )
    ends = sided.groupBy("seam").agg(
        F.max(F.when(F.col("left"), F.col("value"))).alias("above"), F.min(F.when(~F.col("left"), F.col("value"))).alias("below")
    )
    none = F.lit(None).cast("double")
    bounds = ends.where(F.col("above") > F.col("below")).withColumns(
        {"sure_total": F.lit(0.0), "sure_weight": F.lit(0.0), "sure_low": none, "sure_high": none}
    )

    def between(bounds: DataFrame) -> DataFrame:
        keys = bounds.select("seam", "below", "above")
        found = sided.join(keys, "seam").where(F.col("value").between(F.col("below"), F.col("above")))
        return found.select("seam", "left", "low", "high", "total", "weight", "value")

    bounds = bounds.checkpoint()
    candidates = between(bounds)
    for _ in range(8):
        most = candidates.groupBy("seam").count().agg(F.max("count")).first()[0] or 0
        if most <= limit:
            break
        bounds = _narrow(candidates, bounds).checkpoint()
        candidates = between(bounds)
    held = candidates.join(bounds, "seam")
    rising = Window.partitionBy("seam").orderBy("value")
    upto, onward = rising.rangeBetween(Window.unboundedPreceding, 0), rising.rangeBetween(0, Window.unboundedFollowing)

    def around(name: str) -> Column:
        left = F.sum(F.when(F.col("left"), F.col(name)).otherwise(0.0)).over(onward)
        return left + F.sum(F.when(~F.col("left"), F.col(name)).otherwise(0.0)).over(upto) + F.col(f"sure_{name}")

    excess = around("total") - F.col("value") * around("weight")
    joins = held.withColumn("excess", excess).where(F.when(F.col("left"), F.col("excess") <= 0).otherwise(F.col("excess") >= 0))
    inner = joins.groupBy("seam").agg(
        F.sum("total").alias("t"), F.sum("weight").alias("w"),
        F.min(F.when(F.col("left"), F.col("low"))).alias("l"), F.max(F.when(~F.col("left"), F.col("high"))).alias("h"),
    )
    return bounds.join(inner, "seam", "left").select(
        "seam",
        F.least("sure_low", "l").alias("low"),
        F.greatest("sure_high", "h").alias("high"),
        (F.col("sure_total") + F.coalesce("t", F.lit(0.0))).alias("total"),
        (F.col("sure_weight") + F.coalesce("w", F.lit(0.0))).alias("weight"),
    )


def fit_blocks(df: DataFrame, score: str, label: str, rows_per_range: int = ROWS_PER_RANGE, candidates: int = CANDIDATES) -> DataFrame:
    """Blocks of the rising step function with the least squared error: low and high score, value, weight."""
    shared_dir(df.sparkSession)
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    table = known.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    ranged = by_ranges(table, "score", rows_per_range).select(RANGE, "score", "total", "weight")
    ranges = ranged.rdd.getNumPartitions()
    blocks = ranged.sortWithinPartitions("score").mapInArrow(_pool, _BLOCK).checkpoint()
    width = 1
    while width < ranges:
        formed = _seams(blocks, width, candidates).checkpoint()
        inside = formed.select(F.col("seam").alias("s"), F.col("low").alias("from"), F.col("high").alias("to"))
        seam = F.floor(F.col(RANGE) / (2 * width))
        # NaN is the greatest double, in comparisons, too.
        taken = (seam == F.col("s")) & (F.col("low") >= F.col("from")) & (F.col("high") <= F.col("to"))
        rest = blocks.join(inside, taken, "left_anti")
        new = formed.select((F.col("seam") * 2 * width).cast("int").alias(RANGE), "low", "high", "total", "weight")
        blocks = rest.unionByName(new).checkpoint()
        width *= 2
    return blocks.select("low", "high", (F.col("total") / F.col("weight")).alias("value"), "weight")


def knots(blocks: DataFrame) -> DataFrame:
    """The corners of the fitted line: (x, y); it is straight between them and level beyond."""
    ends = F.array_distinct(F.array("low", "high"))
    return blocks.select(F.explode(ends).alias("x"), F.col("value").alias("y"))


def interpolate(df: DataFrame, score: str, corners: DataFrame, output: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add the fitted value at ``score``, for any number of corners.

    Distinct scores and corners are dealt out by ranges together; each score gets the corner at or
    before it and the one at or behind it, and a range gets those of its neighbours. A null score has no value.
    """
    asked = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("x")).distinct()
    corner = F.struct("x", "y")
    points = corners.select("x", corner.alias("knot")).unionByName(asked.select("x", F.lit(None).cast("struct<x:double,y:double>").alias("knot")))
    ranged = by_ranges(points, "x", rows_per_range)
    inside = Window.partitionBy(RANGE).orderBy("x")
    upto, onward = inside.rangeBetween(Window.unboundedPreceding, 0), inside.rangeBetween(0, Window.unboundedFollowing)
    near = ranged.select(
        RANGE, "x", "knot", F.last("knot", ignorenulls=True).over(upto).alias("before"), F.first("knot", ignorenulls=True).over(onward).alias("behind")
    )
    # One row for each range.
    ends = ranged.where(F.col("knot").isNotNull()).groupBy(RANGE).agg(F.min_by("knot", "x").alias("first"), F.max_by("knot", "x").alias("last"))
    ends = ranged.select(RANGE).distinct().join(ends, RANGE, "left")
    across = Window.orderBy(RANGE)
    carried = ends.select(
        F.col(RANGE).alias("r"),
        F.last("last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    near = near.where(F.col("knot").isNull()).join(carried, F.col(RANGE) == F.col("r"))
    a, b = F.coalesce("before", "earlier"), F.coalesce("behind", "later")
    near = near.select("x", a.alias("a"), b.alias("b"))
    share = (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    value = (
        F.when(F.col("a").isNull(), F.col("b.y"))
        .when(F.col("b").isNull() | (F.col("a.x") == F.col("x")), F.col("a.y"))
        .otherwise(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * share)
    )
    at = near.select(F.col("x").alias("__x"), value.alias(output))
    return df.join(at, F.col(score).cast("double") == F.col("__x"), "left").drop("__x")
