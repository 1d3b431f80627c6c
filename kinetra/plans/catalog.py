"""All queries of the motion operators with their SQL."""

from __future__ import annotations

from kinetra.plans import q_compound, q_derived, q_editing, q_joins, q_pointwise, q_sequential, q_sources, q_streaming, q_tracks, q_windows  # noqa: F401
from kinetra.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
