"""All registered queries."""

from verdictframe.plans import analytics, gates, planning, runs, scalars, scoring, storage, streams  # noqa: F401
from verdictframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
