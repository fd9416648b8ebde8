"""All registered queries."""

from agorametrics.plans import account_queries, ingest_queries, post_queries, text_queries  # noqa: F401
from agorametrics.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
