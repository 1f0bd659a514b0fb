"""All queries over the driver's tables, by name."""

from . import domain_queries, graph_queries, model_queries, order_queries, source_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
