"""All queries of the engine's own operators."""

from . import catalog_queries, document_queries, event_queries, evidence_queries, lifecycle_queries, outline_queries, purge_queries, retrieval_queries, routing_queries, service_queries, structure_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
