"""Registered queries over the driver's tables and the SQL that states the same result."""

from __future__ import annotations

from matchlake.plans import checks, combats, episodes, marks, moments, presence, relations, service, statistics, stores, streams, timelines, upkeep  # noqa: F401  (they register)
from matchlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
