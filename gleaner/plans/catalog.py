"""All registered queries."""

from gleaner.plans import evaluation, facts, images, long_runs, scoring, shifts, storage, streams, subsets, valuation  # noqa: F401
from gleaner.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
