"""All queries of the library, and their SQL."""

from __future__ import annotations

from tessera.plans import alignment, programs, responses, scores, similarity, sinks
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "alignment", "programs", "responses", "scores", "similarity", "sinks"]
