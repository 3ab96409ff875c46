"""Queries that exercise every operator on the test tables."""

from runsift.workload import catalogue, dialects, lines, scoring, streams  # noqa: F401
from runsift.workload.registry import ENTRIES

__all__ = ["ENTRIES"]
