"""Sessions, features and replay on streams, with state kept per trajectory or session.

State is bounded: the last five rows, the session number and the session start of a trajectory.
A call of a handler has a cost of its own, many times that of a row, so trajectories are dealt out
by hash to ``BUCKETS`` buckets: a bucket's trajectories are worked on together, as arrays, and
their states are stored as one value. Rows of a
micro-batch are put in time order inside the handler; a row older than the state is given
back with ``late`` set and without features, so nothing is lost silently. The size of a
micro-batch is bounded by the source options, which also bounds what one bucket can bring.
Times must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from steadycast.operators.features import require_columns
from steadycast.params import TRAJECTORY, SessionParams

RING = 5
MEASURES = ["throughput_mbps", "current_mos", "plr_percent", "latitude", "longitude"]
PASS_THROUGH = [("event_id", LongType()), ("ts_us", LongType())]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

KEY_TYPES = [StructField(k, LongType()) for k in TRAJECTORY]
ONLINE_COLUMNS = {
    "gap_seconds": DoubleType(), "session_number": IntegerType(), "session_step": IntegerType(),
    "elapsed_session_seconds": DoubleType(), "throughput_lag1": DoubleType(),
    "throughput_lag2": DoubleType(), "mos_lag1": DoubleType(), "plr_lag1": DoubleType(),
    "latitude_lag1": DoubleType(), "longitude_lag1": DoubleType(),
    "throughput_past_mean_3": DoubleType(), "mos_past_mean_3": DoubleType(),
    "plr_past_mean_3": DoubleType(), "throughput_past_mean_5": DoubleType(),
    "mos_past_mean_5": DoubleType(), "plr_past_mean_5": DoubleType(),
    "throughput_past_std_5": DoubleType(), "mos_past_std_5": DoubleType(),
}
ONLINE_SCHEMA = StructType(
    [
        *KEY_TYPES,
        *[StructField(n, t) for n, t in PASS_THROUGH],
        StructField("late", BooleanType()),
        *[StructField(n, t) for n, t in ONLINE_COLUMNS.items()],
    ]
)
BUCKETS = 2048
"""Buckets at every size of the stream: state is read and written once a bucket and micro-batch."""
# Handlers get names that begin with an underscore as numbers.
BUCKET, NULLS = "bucket", "null_keys"
_STATE = StructType(
    [
        StructField("keys", ArrayType(LongType())),
        StructField("last_us", ArrayType(LongType())),
        StructField("start_us", ArrayType(LongType())),
        StructField("session_number", ArrayType(LongType())),
        StructField("step", ArrayType(LongType())),
        StructField("ring", ArrayType(DoubleType())),
    ]
)


def _bucketed(stream: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Trajectories dealt out to buckets. Null keys become 0 and are told by the bits of ``NULLS``, so keys stay whole numbers."""
    nulls = sum((F.col(k).isNull().cast("long") * (1 << i) for i, k in enumerate(TRAJECTORY)), F.lit(0).cast("long"))
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast("long") for k in TRAJECTORY], nulls), F.lit(buckets))
    keys = [F.coalesce(F.col(k).cast("long"), F.lit(0)).alias(k) for k in TRAJECTORY]
    return stream.select(bucket.alias(BUCKET), *keys, nulls.alias(NULLS), *columns)


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """All rows of a call, by key and ``order``."""
    frame = pd.concat(list(rows), ignore_index=True)
    if frame["ts_us"].isna().any():
        raise ValueError("ts_us must not be null")
    return frame.sort_values(order, kind="stable").reset_index(drop=True)


_KEYS = [*TRAJECTORY, NULLS]


def _met(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the number of its trajectory, per trajectory its keys and its place in ``known``, or -1.

    Rows of a trajectory stand together.
    """
    first = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
    places = {k: i for i, k in enumerate(map(tuple, known.tolist()))}
    own = keys[first]
    return np.cumsum(first) - 1, own, np.array([places.get(k, -1) for k in map(tuple, own.tolist())], np.int64)


def _key_columns(keys: np.ndarray) -> dict[str, pd.Series]:
    """The key columns as they came, nulls included."""
    return {
        k: pd.Series(pd.arrays.IntegerArray(keys[:, i].copy(), (keys[:, -1] >> i & 1).astype(bool)))
        for i, k in enumerate(TRAJECTORY)
    }


def _updated(held: np.ndarray, places: np.ndarray, now: np.ndarray) -> np.ndarray:
    """State rows with those at ``places`` replaced by ``now``, new ones (-1) behind."""
    held, old = held.copy(), places >= 0
    held[places[old]] = now[old]
    return np.concatenate([held, now[~old]])


def _starts(code: np.ndarray) -> np.ndarray:
    """First rows of runs of equal numbers."""
    return np.flatnonzero(np.append(True, code[1:] != code[:-1]))


def _past(values: np.ndarray, place: np.ndarray, steps: np.ndarray, size: int) -> np.ndarray:
    """Rows: 1..size steps before ``place``; values from before the session start are missing."""
    return np.stack([np.where(steps < k, np.nan, values[place - k]) for k in range(1, size + 1)])


def _mean(rows: np.ndarray) -> np.ndarray:
    count = (~np.isnan(rows)).sum(axis=0)
    total = np.nansum(rows, axis=0)
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def _std(rows: np.ndarray) -> np.ndarray:
    count = (~np.isnan(rows)).sum(axis=0)
    spread = np.nansum((rows - _mean(rows)) ** 2, axis=0)
    return np.where(count > 1, np.sqrt(spread / np.maximum(count - 1, 1)), np.nan)


class OnlineFeatures(StatefulProcessor):
    """Sessionization and past-only features of the trajectories of a bucket."""

    def __init__(self, gap_seconds: float):
        self._gap = gap_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("trajectories", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, [*_KEYS, "ts_us", "event_id"])
        width = RING * len(MEASURES)
        state = self._state.get() if self._state.exists() else ([],) * 6
        known = np.array(state[0], np.int64).reshape(-1, len(_KEYS))
        # Per known trajectory: newest time, session start, session number, step.
        held = np.array(state[1:5], np.int64).reshape(4, -1).T
        rings = np.array(state[5], dtype=float).reshape(-1, width)
        keys = frame[_KEYS].to_numpy()
        code, own, places = _met(keys, known)
        old = places >= 0
        then = np.zeros((len(own), 4), np.int64)
        then[:, 3] = -1
        then[old] = held[places[old]]
        times = frame["ts_us"].to_numpy()
        late = old[code] & (times < then[code, 0])
        if late.any():
            yield self._late(keys[late], frame[late])
        if late.all():
            return
        frame, keys, times, code = frame[~late], keys[~late], times[~late], code[~late]
        # Trajectories with rows left, numbered on.
        firsts = _starts(code)
        left = code[firsts]
        then, old, places, own = then[left], old[left], places[left], own[left]
        counts = np.diff(np.append(firsts, len(code)))
        at = np.repeat(np.arange(len(firsts)), counts)
        index = np.arange(len(times))
        before = np.append(times[0], times[:-1])
        before[firsts] = np.where(old, then[:, 0], times[firsts])
        gaps = (times - before) / 1e6
        gaps[firsts[~old]] = np.nan
        starts = np.isnan(gaps) | (gaps > self._gap)
        run = np.cumsum(starts)
        numbers = then[at, 2] + run - (run[firsts] - starts[firsts])[at]
        begun = np.maximum.accumulate(np.where(starts, index, -1))
        inside = begun >= firsts[at]
        steps = np.where(inside, index - begun, then[at, 3] + 1 + index - firsts[at])
        began_at = np.where(inside, times[np.maximum(begun, 0)], then[at, 1])
        # Before the rows of each trajectory stand its last RING rows.
        place = index + RING * (at + 1)
        values = np.full((len(times) + RING * len(firsts), len(MEASURES)), np.nan)
        values[place] = frame[MEASURES].to_numpy(dtype=float)
        ahead = (firsts + RING * np.arange(len(firsts)))[:, None] + np.arange(RING)
        values[ahead[old]] = rings[places[old]].reshape(-1, RING, len(MEASURES))
        back = {m: _past(values[:, i], place, steps, RING) for i, m in enumerate(MEASURES)}
        tput, mos, plr = back["throughput_mbps"], back["current_mos"], back["plr_percent"]
        given = {
            **_key_columns(keys),
            **{n: frame[n].to_numpy() for n, _ in PASS_THROUGH},
            "late": np.zeros(len(frame), dtype=bool),
            "gap_seconds": gaps,
            "session_number": numbers.astype("int32"),
            "session_step": steps.astype("int32"),
            "elapsed_session_seconds": (times - began_at) / 1e6,
            "throughput_lag1": tput[0], "throughput_lag2": tput[1], "mos_lag1": mos[0],
            "plr_lag1": plr[0], "latitude_lag1": back["latitude"][0],
            "longitude_lag1": back["longitude"][0],
            "throughput_past_mean_3": _mean(tput[:3]), "mos_past_mean_3": _mean(mos[:3]),
            "plr_past_mean_3": _mean(plr[:3]), "throughput_past_mean_5": _mean(tput),
            "mos_past_mean_5": _mean(mos), "plr_past_mean_5": _mean(plr),
            "throughput_past_std_5": _std(tput), "mos_past_std_5": _std(mos),
        }
        yield pd.DataFrame(given)[ONLINE_SCHEMA.fieldNames()]
        ends = firsts + counts - 1
        now = np.stack([times[ends], began_at[ends], numbers[ends], steps[ends]], axis=1)
        newest = values[place[ends][:, None] + np.arange(1 - RING, 1)].reshape(-1, width)
        held = _updated(held, places, now)
        self._state.update(
            (
                _updated(known, places, own).ravel().tolist(), *(held[:, i].tolist() for i in range(4)),
                _updated(rings, places, newest).ravel().tolist(),
            )
        )

    @staticmethod
    def _late(keys: np.ndarray, frame: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame({**_key_columns(keys), **{n: frame[n].to_numpy() for n, _ in PASS_THROUGH}})
        rows["late"] = True
        for n, kind in ONLINE_COLUMNS.items():
            missing = pd.Series([None] * len(rows), dtype="Int32" if kind == IntegerType() else "float64")
            rows[n] = missing
        return rows[ONLINE_SCHEMA.fieldNames()]

    def close(self) -> None:
        pass


def online_features(stream: DataFrame, params: SessionParams = SessionParams(), buckets: int = BUCKETS) -> DataFrame:
    """Sessions and features of a stream, the same columns as the batch operators give."""
    need = [*[n for n, _ in PASS_THROUGH], *MEASURES]
    require_columns(stream.columns, [*TRAJECTORY, *need], "stream")
    return (
        _bucketed(stream, need, buckets)
        .groupBy(BUCKET)
        .transformWithStateInPandas(
            statefulProcessor=OnlineFeatures(params.gap_seconds),
            outputStructType=ONLINE_SCHEMA,
            outputMode="Append",
            timeMode="None",
        )
    )


REPLAY_SCHEMA = StructType(
    [
        StructField("session_id", StringType()),
        StructField("event_id", LongType()),
        StructField("ts_us", LongType()),
        StructField("late", BooleanType()),
        StructField("probability", DoubleType()),
        StructField("prediction", IntegerType()),
        StructField("history", ArrayType(LongType())),
    ]
)
_REPLAY_STATE = StructType(
    [
        StructField("sessions", ArrayType(StringType())),
        StructField("last_us", ArrayType(LongType())),
        StructField("history", ArrayType(ArrayType(LongType()))),
    ]
)


class Replay(StatefulProcessor):
    """Current state and the last rows of each session of a bucket, current row included."""

    def __init__(self, size: int):
        self._size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("sessions", _REPLAY_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, ["session_id", "ts_us", "event_id"])
        state = self._state.get() if self._state.exists() else ([], [], [])
        held = {s: (last, list(kept)) for s, last, kept in zip(*state)}
        times, events = frame["ts_us"].to_numpy(), frame["event_id"].tolist()
        # Null is a session, too, and not equal to itself.
        names = [s if isinstance(s, str) else None for s in frame["session_id"]]
        firsts = [i for i, s in enumerate(names) if i == 0 or s != names[i - 1]]
        late, histories = np.zeros(len(names), dtype=bool), [None] * len(names)
        for start, stop in zip(firsts, [*firsts[1:], len(names)]):
            last, kept = held.get(names[start], (None, []))
            begin = start if last is None else start + int(np.searchsorted(times[start:stop], last, side="left"))
            late[start:begin] = True
            if begin == stop:
                continue
            line = [*kept, *events[begin:stop]]
            for end in range(len(kept) + 1, len(line) + 1):
                histories[begin + end - len(kept) - 1] = line[max(0, end - self._size):end]
            held[names[start]] = int(times[stop - 1]), [int(e) for e in line[-self._size:]]
        self._state.update((list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]))
        yield pd.DataFrame(
            {
                "session_id": pd.Series(names, dtype=object), "event_id": frame["event_id"], "ts_us": frame["ts_us"],
                "late": late, "probability": frame["probability"],
                "prediction": frame["prediction"].astype("int32"), "history": histories,
            }
        )

    def close(self) -> None:
        pass


def replay(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = 0.5, size: int = RING,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Score each row from its own features, then keep state per session.

    ``score`` adds ``probability`` and must not read outcome columns; a fitted pipeline's
    ``transform`` fits. A new checkpoint starts a new replay.
    """
    require_columns(stream.columns, ["session_id", "event_id", "ts_us"], "replay")
    outcomes = [c for c in stream.columns if c.startswith("future_") or c == "prediction_lead_seconds"]
    scored = score(stream.drop(*outcomes)).withColumn(
        "prediction", (F.col("probability") >= threshold).cast("int")
    )
    return (
        scored.select(
            F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias(BUCKET), "session_id", "event_id", "ts_us", "probability", "prediction"
        )
        .groupBy(BUCKET)
        .transformWithStateInPandas(
            statefulProcessor=Replay(size),
            outputStructType=REPLAY_SCHEMA,
            outputMode="Append",
            timeMode="None",
        )
    )


def latest_state_stream(stream: DataFrame, fields: list[str]) -> DataFrame:
    """Last row per session; run in update mode."""
    newest = F.max_by(F.struct(*fields), F.col("ts_us")).alias("last")
    return stream.groupBy("session_id").agg(newest).select("session_id", "last.*")


AGGREGATE_SCHEMA = StructType(
    [
        *KEY_TYPES,
        StructField("session_number", IntegerType()),
        StructField("start_us", LongType()),
        StructField("end_us", LongType()),
        StructField("rows", LongType()),
        StructField("mos_billionths", LongType()),
        StructField("mos_rows", LongType()),
        StructField("open", BooleanType()),
        StructField("late", BooleanType()),
    ]
)
_TOTALS = [f.name for f in AGGREGATE_SCHEMA.fields if f.name not in (*TRAJECTORY, "open", "late")]
_AGGREGATE_STATE = StructType([StructField(n, ArrayType(LongType())) for n in ("keys", *_TOTALS)])


def _billionths(values: np.ndarray) -> np.ndarray:
    """Whole billionths, whose sum does not depend on how rows fall into batches."""
    return np.rint(np.nan_to_num(values) * 1e9).astype(np.int64)


class SessionTotals(StatefulProcessor):
    """Totals of the session in progress of each trajectory of a bucket; a gap closes it and begins the next."""

    def __init__(self, gap_seconds: float):
        self._gap = int(gap_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("sessions", _AGGREGATE_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Only keys, times and scores of the batch's rows are held together to put them in order.
        frame = _in_order((r[[*_KEYS, "ts_us", "current_mos"]] for r in rows), [*_KEYS, "ts_us"])
        times, mos = frame["ts_us"].to_numpy(), frame["current_mos"].to_numpy(dtype=float)
        state = self._state.get() if self._state.exists() else ([],) * (1 + len(_TOTALS))
        known = np.array(state[0], np.int64).reshape(-1, len(_KEYS))
        held = np.array(state[1:], np.int64).reshape(len(_TOTALS), -1).T
        code, own, places = _met(frame[_KEYS].to_numpy(), known)
        old = places >= 0
        then = np.zeros((len(own), len(_TOTALS)), np.int64)
        then[old] = held[places[old]]
        late = old[code] & (times < then[code, 2])
        if late.any():
            totals = self._totals(code[late], times[late], mos[late], _starts(code[late]))
            yield self._given(own[code[late][_starts(code[late])]], totals, None, True)
        if late.all():
            return
        times, mos, code = times[~late], mos[~late], code[~late]
        firsts = _starts(code)
        left = code[firsts]
        then, old, places, own = then[left], old[left], places[left], own[left]
        before = np.append(times[0], times[:-1])
        before[firsts] = np.where(old, then[:, 2], times[firsts])
        starts = times - before > self._gap
        starts[firsts[~old]] = True
        opened = starts.copy()
        opened[firsts] = True
        parts = np.flatnonzero(opened)
        at = np.searchsorted(firsts, parts, side="right") - 1
        totals = self._totals(code, times, mos, parts)
        run = np.cumsum(starts)
        totals[:, 0] = then[at, 0] + run[parts] - (run[firsts] - starts[firsts])[at]
        # The first part of a trajectory goes on with the session held, or closes it.
        goes_on = ~starts[parts]
        totals[goes_on, 1] = then[at[goes_on], 1]
        totals[goes_on, 3:] += then[at[goes_on], 3:]
        closed = old & starts[firsts]
        if closed.any():
            yield self._given(own[closed], then[closed], False, False)
        final = np.append(at[1:] != at[:-1], True)
        yield self._given(own[at], totals, final, False)
        held = _updated(held, places, totals[final])
        self._state.update((_updated(known, places, own).ravel().tolist(), *(held[:, i].tolist() for i in range(len(_TOTALS)))))

    @staticmethod
    def _totals(code: np.ndarray, times: np.ndarray, mos: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The columns of ``_TOTALS`` of each part, numbers left 0; ``parts`` are the first rows."""
        ends = np.append(parts[1:], len(code))
        sums = [np.add.reduceat(c, parts) for c in (_billionths(mos), (~np.isnan(mos)).astype(np.int64))]
        return np.stack([np.zeros(len(parts), np.int64), times[parts], times[ends - 1], ends - parts, *sums], axis=1)

    @staticmethod
    def _given(keys: np.ndarray, totals: np.ndarray, is_open: Any, late: bool) -> pd.DataFrame:
        given = pd.DataFrame({**_key_columns(keys), **{n: totals[:, i] for i, n in enumerate(_TOTALS)}})
        given["session_number"] = given["session_number"].astype("Int32").mask(np.full(len(given), late))
        given["open"] = pd.Series([None] * len(given), dtype=object) if late else is_open
        given["late"] = late
        return given[AGGREGATE_SCHEMA.fieldNames()]

    def close(self) -> None:
        pass


def session_aggregates_stream(stream: DataFrame, params: SessionParams = SessionParams(), buckets: int = BUCKETS) -> DataFrame:
    """Sessions as they grow: every session a batch touches, with ``open`` while it may go on.

    Run in update mode; ``latest_sessions`` gives the last word on each. Rows older than their
    trajectory's newest row are not added to a session that may be closed already: they come
    back counted, with ``late`` set.
    """
    require_columns(stream.columns, [*TRAJECTORY, "ts_us", "current_mos"], "stream")
    return (
        _bucketed(stream, ["ts_us", "current_mos"], buckets)
        .groupBy(BUCKET)
        .transformWithStateInPandas(
            statefulProcessor=SessionTotals(params.gap_seconds),
            outputStructType=AGGREGATE_SCHEMA,
            outputMode="Update",
            timeMode="None",
        )
    )


def latest_sessions(updates: DataFrame) -> DataFrame:
    """Start, end, rows, mean score and ``open`` of every session from its last update."""
    fields = ["start_us", "end_us", "rows", "mos_billionths", "mos_rows", "open"]
    # A session only grows, and is closed once: of equal updates the closed one is the last.
    order = F.struct("batch", F.col("rows"), (~F.col("open")).alias("closed"))
    last = updates.where(~F.col("late")).groupBy(*TRAJECTORY, "session_number").agg(F.max_by(F.struct(*fields), order).alias("s"))
    total = F.col("mos_billionths").cast("decimal(19,0)") / F.lit(10**9).cast("decimal(10,0)")
    mean = (total / F.col("mos_rows")).cast("double").alias("mean_mos")
    return last.select(*TRAJECTORY, "session_number", "s.*").select(
        *TRAJECTORY, "session_number", "start_us", "end_us", "rows", "open", F.when(F.col("mos_rows") > 0, mean).alias("mean_mos")
    )


def late_rows(result: DataFrame) -> DataFrame:
    """Rows given back as late, counted."""
    return result.agg(F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late_rows"))
