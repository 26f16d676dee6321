"""All analytics queries with their SQL counterparts."""

from __future__ import annotations

from plumbline.plans import advice_queries, analyzer_queries, complexity_queries, file_queries, report_queries  # the others register with file_queries

QUERIES = dict(file_queries.QUERIES)
assert advice_queries and analyzer_queries and complexity_queries and report_queries
ORACLES = dict(file_queries.ORACLES)
