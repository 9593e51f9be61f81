"""All queries and their SQL."""

from __future__ import annotations

from . import access_queries, account_queries, admin_queries, function_queries, ingest_queries, report_queries, retrieval_queries, state_queries, structure_queries, validation_queries  # noqa: F401  (each registers its queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
