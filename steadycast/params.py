"""Parameters of the jobs. Plain dataclasses, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass

TRAJECTORY = ("base_station", "prb", "bitrate_kbps", "user_id")
SESSION = TRAJECTORY + ("session_number",)
ROW_KEY = ("session_id", "user_id", "timestamp")
PHYSICAL_KEY = ("base_station", "mobility", "prb", "user_id", "timestamp")
ROW_IDENTITY = PHYSICAL_KEY + ("bitrate_kbps",)

# The selectable bitrates and the resolution each one is shown at.
RESOLUTION_BY_BITRATE = {2000: "720p", 4000: "1080p", 6000: "1080p", 8000: "1080p"}


@dataclass(frozen=True)
class SessionParams:
    """Gap that ends a session, label threshold and label horizon."""

    gap_seconds: float = 30.0
    poor_mos: float = 3.0
    horizon: int = 1

    def __post_init__(self) -> None:
        if self.gap_seconds <= 0:
            raise ValueError("gap_seconds must be positive")
        if self.horizon < 1:
            raise ValueError("horizon must be at least one row")


@dataclass(frozen=True)
class SplitParams:
    """Shares of the distinct timestamps given to train and validation."""

    train: float = 0.60
    validation: float = 0.20

    def __post_init__(self) -> None:
        if self.train <= 0 or self.validation <= 0 or self.train + self.validation >= 1:
            raise ValueError("split shares must be positive and sum to less than one")


@dataclass(frozen=True)
class TrustPolicy:
    """Weights of the reliability score, level cuts and abstention rule."""

    # The published weights and cuts.
    confidence: float = 0.40
    validation: float = 0.30
    calibration: float = 0.20
    quality: float = 0.10
    high: float = 0.80
    medium: float = 0.55
    abstention_enabled: bool = True
    minimum_coverage: float = 0.90

    def __post_init__(self) -> None:
        weights = (self.confidence, self.validation, self.calibration, self.quality)
        if any(not 0 <= w <= 1 for w in weights) or abs(sum(weights) - 1) > 1e-9:
            raise ValueError("trust weights must lie in [0, 1] and sum to one")
        if not 0 <= self.medium < self.high <= 1:
            raise ValueError("level cuts must satisfy 0 <= medium < high <= 1")
        if not 0.90 <= self.minimum_coverage <= 1:
            raise ValueError("minimum_coverage must be between 0.90 and 1.0")


@dataclass(frozen=True)
class ModelParams:
    """Model settings."""

    # The published model configuration.
    max_iter: int = 2000
    trees: int = 100
    depth: int = 14
    leaf: int = 20
    sample_share: float = 0.5
    seed: int = 42
    max_bins: int = 64
    memory_mb: int = 1024
    fit_partitions: int = 0
    own_weights: bool = False
    """Class weights of each tree's own bootstrap, a job a tree, in place of one weight for all."""


def unit_interval(value: float, name: str, *, open_ends: bool = False) -> float:
    """Return ``value`` when it lies in [0, 1] (or (0, 1)), else raise."""
    inside = 0 < value < 1 if open_ends else 0 <= value <= 1
    if not inside:
        raise ValueError(f"{name} must be inside {'(0, 1)' if open_ends else '[0, 1]'}")
    return float(value)
