"""Registered queries over the driver's tables and their SQL."""

from cartlake.plans import cdc_queries, churn_queries, recommend_queries, source_queries, star_queries, stream_queries  # noqa: F401  (register)
from cartlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
