"""All registered queries of the engine."""

from . import density_queries, finding_queries, function_queries, graph_queries, ingest_queries, lookup_queries, prediction_queries, rank_queries, record_queries, resolution_queries, result_queries, source_queries, state_queries, text_graph_queries, watch_queries  # noqa: F401  register on import
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
