"""The catalogue of queries: name to callable, and name to the SQL that gives the same rows."""

from __future__ import annotations

from millrace.plans import filter_queries, mapping_queries, report_queries, source_queries

QUERIES = mapping_queries.QUERIES | filter_queries.QUERIES | report_queries.QUERIES | source_queries.QUERIES
SQL = mapping_queries.SQL | filter_queries.SQL | report_queries.SQL | source_queries.SQL
survivors_by_language = filter_queries.survivors_by_language
