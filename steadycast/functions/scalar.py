"""Scalar expressions over telemetry, probability and trust columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from steadycast.params import TrustPolicy, unit_interval

EARTH_RADIUS_KM = 6371.0088


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds from ``start`` to ``end`` (works for both timestamp types)."""
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds as a double, exact to the microsecond."""
    return micros_between(start, end) / F.lit(1e6)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 for a zone-free timestamp."""
    return micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def number_or_null(column: Column) -> Column:
    """A double with NaN turned into null."""
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def clip01(column: Column) -> Column:
    """Clamp to [0, 1]; null stays null."""
    return F.when(column < 0, 0.0).when(column > 1, 1.0).otherwise(column)


def exact_mean(column: Column) -> Column:
    """Mean of whole billionths, so that it does not depend on the order of adding.

    Values that do not fit (NaN, infinite, 9 * 10^9 or more) make it a plain average.
    """
    value = column.cast("double")
    fits = ~F.isnan(value) & (F.abs(value) < 9e9)
    whole = F.when(fits, F.rint(value * 1e9)).cast("long").cast("decimal(19,0)")
    exact = (F.sum(whole) / F.count(value)).cast("double") / 1e9
    return F.when(F.bool_and(fits), exact).otherwise(F.avg(value))


def haversine_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Great-circle distance between two points in kilometres."""
    half_lat = (F.radians(lat) - F.radians(lat0)) / 2
    half_lon = (F.radians(lon) - F.radians(lon0)) / 2
    chord = (
        F.sin(half_lat) * F.sin(half_lat)
        + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * F.sin(half_lon) * F.sin(half_lon)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clip01(chord)))


def speed_kmh(distance_km: Column, gap_seconds: Column) -> Column:
    """Speed over a positive gap, else null."""
    return F.when(gap_seconds > 0, distance_km / gap_seconds * 3600)


def capacity_columns(throughput: Column, bitrate_kbps: Column) -> dict[str, Column]:
    """Bitrate in Mbps, ratio, margin and the strict shortfall flag."""
    mbps = bitrate_kbps / F.lit(1000.0)
    return {
        "bitrate_mbps": mbps,
        "throughput_to_bitrate_ratio": F.try_divide(throughput, mbps),
        "capacity_margin_mbps": throughput - mbps,
        "capacity_insufficient": F.coalesce(throughput < mbps, F.lit(False)).cast("byte"),
    }


def persistence_probability(mos: Column, poor_mos: float = 3.0) -> Column:
    """1.0 when the current score is poor, else 0.0."""
    return F.when(mos < poor_mos, 1.0).otherwise(0.0)


def decide(probability: Column, threshold: float) -> Column:
    """1 when the probability reaches the threshold."""
    return (probability >= F.lit(threshold)).cast("int")


def finite_or_fail(column: Column, name: str) -> Column:
    """The column itself; null, NaN and infinities stop the job."""
    bad = column.isNull() | F.isnan(column) | (F.abs(column) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} must be finite"))).otherwise(column)


def probability_confidence(probability: Column, threshold: float) -> Column:
    """Distance from the threshold, scaled to one at each end."""
    unit_interval(threshold, "threshold", open_ends=True)
    p = clip01(finite_or_fail(probability, "probability"))
    cut = F.lit(threshold)
    return clip01(F.when(p < cut, (cut - p) / cut).otherwise((p - cut) / (1 - cut)))


def data_quality(columns: Sequence[str], required: Sequence[str]) -> Column:
    """Share of required columns that hold a value; an absent column counts as missing."""
    if not required:
        return F.lit(1.0)
    usable = [F.col(c).isNotNull().cast("int") for c in required if c in set(columns)]
    total = usable[0] if usable else F.lit(0)
    for flag in usable[1:]:
        total = total + flag
    return total / F.lit(float(len(required)))


def configured_trust(
    confidence: Column, f1: float, ece: float, quality: Column, policy: TrustPolicy
) -> Column:
    """Weighted reliability score; stability is carried elsewhere and not weighted."""
    fixed = policy.validation * min(max(f1, 0.0), 1.0) + policy.calibration * (
        1.0 - min(max(ece, 0.0), 1.0)
    )
    return clip01(policy.confidence * confidence + F.lit(fixed) + policy.quality * clip01(quality))


def trust_level(score: Column, high: float, medium: float) -> Column:
    """'high', 'medium' or 'low'."""
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def abstains(score: Column, threshold: float, policy: TrustPolicy) -> Column:
    """True when abstention is on and the score is below the selected threshold."""
    unit_interval(threshold, "abstention threshold")
    return F.lit(policy.abstention_enabled) & (score < F.lit(threshold))


def component_trust(
    probability: Column,
    f1: float,
    ece: float,
    quality: Column,
    stability: Column,
    *,
    weights: tuple[float, float, float, float] = (0.55, 0.25, 0.10, 0.10),
    abstention: float = 0.55,
) -> dict[str, Column]:
    """Component variant of the score; its abstention cut is also the medium cut."""
    w_conf, w_val, w_quality, w_stability = weights
    validation = 0.70 * min(max(f1, 0.0), 1.0) + 0.30 * (1.0 - min(max(ece, 0.0), 1.0))
    score = clip01(
        w_conf * probability_confidence(probability, 0.5)
        + F.lit(w_val * validation)
        + w_quality * clip01(quality)
        + w_stability * clip01(stability)
    )
    return {
        "component_trust": score,
        "component_level": trust_level(score, 0.80, abstention),
        "component_abstain": score < F.lit(abstention),
    }


def stability_from_spread(spread: Column) -> Column:
    """One minus the population deviation of recent probabilities over 0.5, clipped."""
    return clip01(1.0 - F.least(spread / 0.5, F.lit(1.0)))


# The inner edges of ten equal bins as doubles, so that both sides of a
# comparison bind the same numbers (0.3 and 0.7 are not the nearest doubles of k/10).
TEN_BIN_EDGES = tuple(i * 0.1 for i in range(1, 10))


def bin_edges(bins: int) -> list[float]:
    """Inner edges of ``bins`` equal bins over [0, 1]."""
    return [i * (1.0 / bins) for i in range(1, bins)]


def right_closed_bin(probability: Column, bins: int = 10) -> Column:
    """1-based bin index; bins are closed on the right and 0 falls into the first."""
    index = F.lit(1)
    for edge in bin_edges(bins):
        index = index + (probability > F.lit(edge)).cast("int")
    return index
