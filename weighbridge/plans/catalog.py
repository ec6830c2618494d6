"""Importing this module registers every query."""

from weighbridge.plans import (  # noqa: F401
    contamination_queries,
    conversion_queries,
    feed_queries,
    line_queries,
    readout_queries,
    scoring_queries,
    selection_queries,
)
from weighbridge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
