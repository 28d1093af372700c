"""Queries over the driver's tables, with their SQL."""

from . import hybrid, queries, study

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES

__all__ = ["ORACLES", "QUERIES", "hybrid", "study"]
