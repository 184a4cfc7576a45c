"""The registered queries: functions and operators applied to the tables."""

from . import grouped_queries, layout_queries, reference_queries, rules_queries, search_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
