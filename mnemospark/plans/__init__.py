"""Registered queries of the conversation-memory engine."""

from . import flow_queries, measure_queries, rank_queries, state_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
