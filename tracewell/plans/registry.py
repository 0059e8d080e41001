"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import effect_queries, source_queries, study_queries, summary_queries, text_queries, trace_queries

QUERIES = trace_queries.QUERIES | study_queries.QUERIES | summary_queries.QUERIES | effect_queries.QUERIES | text_queries.QUERIES | source_queries.QUERIES
SQL = trace_queries.SQL | study_queries.SQL | summary_queries.SQL | effect_queries.SQL | text_queries.SQL | source_queries.SQL
