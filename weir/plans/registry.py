"""All queries of the crawl operators, and their SQL."""

from __future__ import annotations

from weir.plans import crawl_queries, document_queries, function_queries, stream_queries
from weir.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "crawl_queries", "document_queries", "function_queries", "stream_queries"]
