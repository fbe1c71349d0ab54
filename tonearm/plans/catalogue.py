"""All queries of the library engine."""

from . import rule_queries, scale_queries, store_queries, tree_queries, vector_queries  # noqa: F401  they register themselves
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
