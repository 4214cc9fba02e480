"""All registered queries."""

from __future__ import annotations

from steadycast.plans import (  # noqa: F401
    explain_queries,
    metric_queries,
    model_queries,
    quality_queries,
    session_queries,
    source_queries,
    stream_queries,
)
from steadycast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
