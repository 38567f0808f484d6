"""All registered queries."""

from tokenloom.plans import corpus_queries, runtime_queries  # noqa: F401
from tokenloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
