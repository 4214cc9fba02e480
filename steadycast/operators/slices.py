"""Ordered per-key windows that survive a key holding a large share of the rows.

A window partitioned by a key puts all rows of that key into one task. When some key
holds more than ``hot_rows`` rows, its rows are range-partitioned by (key, order) into
slices, and every slice receives the few rows next to it (the halo), so bounded frames
(lag, lead, rolling) are exact inside a slice. Running totals take the totals of the
preceding slices as a carry. Keys below the limit keep the plain window.

A chain of operators cuts once: ``lay_out`` gives a frame whose slices and halos stay in it, all
operators that meet such a frame work inside it, and ``close`` drops what is not a row of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from steadycast.session import shared_dir

HOT_ROWS = 5_000_000
BROADCAST_KEYS = 200_000
SLICE, HALO = "__slice", "__halo"
AHEAD, BEHIND = 1, 2
"""``HALO`` of copies of earlier and of later rows; the frame's own rows have 0."""
STEP, BEGAN = "__step", "__began"


@dataclass(frozen=True)
class HotKeys:
    """Keys above the limit, as a stored table. ``keys`` of them hold ``rows`` rows."""

    frame: DataFrame
    columns: tuple[str, ...]
    rows: int
    limit: int
    keys: int

    def table(self) -> DataFrame:
        """The keys for a join: broadcast if their counted number allows, else left to a shuffle."""
        return F.broadcast(self.frame) if self.keys <= BROADCAST_KEYS else self.frame


def find_hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> HotKeys | None:
    """Keys with more than ``hot_rows`` rows, or None. One combined count job at most."""
    shared_dir(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).checkpoint()
    size, rows = counts.agg(F.count(F.lit(1)), F.sum("__n")).first()
    return HotKeys(counts.select(*keys), tuple(keys), int(rows), hot_rows, int(size)) if size else None


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


@dataclass(frozen=True)
class OrderedFrame:
    """A frame whose windows over ``keys`` (plus the slice) are exact for bounded frames."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool
    open: bool = False

    def window(self, *extra: str) -> WindowSpec:
        slice_key = (SLICE,) if self.sliced else ()
        return Window.partitionBy(*self.keys, *slice_key, *extra).orderBy(*self.order)

    def own(self) -> Column:
        """True for rows of the frame itself, false for halo copies."""
        return F.col(HALO) == 0 if self.sliced else F.lit(True)

    def carry(
        self,
        df: DataFrame,
        sums: dict[str, Column] | None = None,
        mins: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Add, per row, sums and minima over all preceding slices of its key."""
        sums, mins = sums or {}, mins or {}
        if not self.sliced:
            zeros = {name: F.lit(0).cast("long") for name in sums}
            nulls = {name: F.lit(None) for name in mins}
            return df.withColumns({**zeros, **nulls})
        on = [*self.keys, SLICE]
        totals = (
            df.where(F.col(HALO) == 0)
            .groupBy(*on)
            .agg(
                *[F.sum(c).alias(n) for n, c in sums.items()],
                *[F.min(c).alias(n) for n, c in mins.items()],
            )
        )
        before = (
            Window.partitionBy(*self.keys)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        totals = totals.select(
            *[F.col(c).alias(f"__r_{c}") for c in on],
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
            *[F.min(n).over(before).alias(n) for n in mins],
        )
        match = reduce(
            lambda a, b: a & b, [df[c].eqNullSafe(totals[f"__r_{c}"]) for c in on]
        )
        return df.join(totals, match, "left").drop(*[f"__r_{c}" for c in on])

    def number_runs(self, df: DataFrame, starts: Column, time: str, number: str) -> DataFrame:
        """Number the runs that begin where ``starts`` holds, and say how far into its run each row is.

        Each slice gives one summary: its rows and starts, and place and time of its last start. What
        the slices before add up to is joined to the rows, one row a slice; then ``number`` (from 1),
        the place in the run (from 0) and the time at which it began follow inside the slice.
        """
        w = self.window()
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*self.keys, SLICE)
        own = self.own()
        df = df.withColumns({"__start": starts, "__place": F.sum(own.cast("long")).over(upto) - 1})
        began = own & F.col("__start")
        ends = df.where((F.col(HALO) == 0) & (F.col(SLICE) >= 0)).groupBy(*self.keys, SLICE).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if("__start").alias("starts"),
            F.max(F.when(F.col("__start"), F.col("__place"))).alias("last"), F.max(F.when(F.col("__start"), F.col(time))).alias("at"),
        )
        across = Window.partitionBy(*self.keys).orderBy(SLICE)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("__rows", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        ends = ends.select(
            *[F.col(c).alias(f"__r_{c}") for c in (*self.keys, SLICE)], "__rows",
            F.sum("starts").over(before).alias("__starts"),
            F.max(F.col("__rows") + F.col("last")).over(before).alias("__open"),
            F.max("at").over(before).alias("__since"),
        )
        match = reduce(lambda a, b: a & b, [df[c].eqNullSafe(ends[f"__r_{c}"]) for c in (*self.keys, SLICE)])
        df = df.join(ends, match, "left")
        place = F.coalesce("__rows", F.lit(0)) + F.col("__place")
        # Copies of earlier rows are numbered backwards from the run that is open where the slice begins.
        running = F.sum(F.col("__start").cast("long")).over(upto)
        ahead = F.sum(F.when(F.col(HALO) == AHEAD, F.col("__start").cast("long")).otherwise(0)).over(whole)
        return df.withColumns(
            {
                number: (F.coalesce("__starts", F.lit(0)) + running - ahead).cast("int"),
                STEP: place - F.greatest("__open", F.max(F.when(began, place)).over(upto)),
                BEGAN: F.greatest("__since", F.max(F.when(began, F.col(time))).over(upto)),
            }
        ).drop("__start", "__place", "__rows", "__starts", "__open", "__since", *[f"__r_{c}" for c in (*self.keys, SLICE)])

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop halo copies and helper columns, if the frame was cut for one operator only."""
        return close(df) if self.sliced and not self.open else df


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot: HotKeys | None = None,
    before: int = 0,
    after: int = 0,
) -> OrderedFrame:
    """Prepare ``df`` for windows by ``keys`` and ``order``.

    ``before`` and ``after`` are how many neighbouring rows the frames may look at.
    ``hot`` may be keyed by a subset of ``keys``. A frame that is laid out already stays as it is.
    """
    keys, order = tuple(keys), tuple(order)
    if SLICE in df.columns:
        return OrderedFrame(df, keys, order, True, True)
    if hot is None:
        return OrderedFrame(df, keys, order, False)
    marked = hot.table()
    cold = df.join(marked, _same(df, hot.frame, hot.columns), "left_anti")
    heavy = df.join(marked, _same(df, hot.frame, hot.columns), "left_semi")
    parts = max(2, -(-2 * hot.rows // hot.limit))
    heavy = (
        heavy.repartitionByRange(parts, *keys, *order)
        .withColumn(SLICE, F.spark_partition_id())
        .checkpoint()  # fixes the slice of every row
    )
    halo = _halo(heavy, keys, order, before, after)
    pieces = [cold.withColumns({SLICE: F.lit(-1), HALO: F.lit(0)}), heavy.withColumn(HALO, F.lit(0))]
    joined = reduce(DataFrame.unionByName, pieces + halo)
    return OrderedFrame(joined, keys, order, True)


def lay_out(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: HotKeys | None, before: int, after: int
) -> DataFrame:
    """Cut ``df`` once for a chain of operators, see ``ordered``; without hot keys it stays as it is.

    ``before`` and ``after`` must be enough for all of the chain. Rows may be filtered and scored on the way.
    """
    return ordered(df, keys, order, hot, before, after).df


def close(df: DataFrame) -> DataFrame:
    """The table's own rows, without what ``lay_out`` added."""
    return df.where(F.col(HALO) == 0).drop(SLICE, HALO, STEP, BEGAN) if SLICE in df.columns else df


def _halo(
    heavy: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], before: int, after: int
) -> list[DataFrame]:
    """Copies of the rows next to each slice: a few rows per key and slice."""
    columns = [c for c in heavy.columns if c != SLICE]
    across = Window.partitionBy(*keys).orderBy(*order)
    inside = Window.partitionBy(*keys, SLICE)
    ascending = [F.col(c) for c in order]
    descending = [F.col(c).desc() for c in order]

    def edges(size: int, outer: list[Column], inner: list[Column], frame: WindowSpec, kind: int) -> DataFrame:
        edge = (
            heavy.withColumn("__rank", F.row_number().over(inside.orderBy(*outer)))
            .where(F.col("__rank") <= size)
            .drop("__rank")
        )
        return (
            edge.withColumn("__near", F.collect_list(F.struct(*columns)).over(frame))
            .withColumn("__first", F.row_number().over(inside.orderBy(*inner)))
            .where(F.col("__first") == 1)
            .select(SLICE, F.explode("__near").alias("__row"))
            .select("__row.*", SLICE)
            .withColumn(HALO, F.lit(kind))
        )

    found = []
    if before:
        found.append(edges(before, descending, ascending, across.rowsBetween(-before, -1), AHEAD))
    if after:
        found.append(edges(after, ascending, descending, across.rowsBetween(1, after), BEHIND))
    return found
