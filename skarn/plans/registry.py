"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from skarn.plans import chunk_queries, extra_queries, job_queries, metric_queries, planning_queries, report_queries, retrieval_queries, source_queries, text_queries

_PARTS = [text_queries, chunk_queries, retrieval_queries, metric_queries, planning_queries, report_queries, source_queries, extra_queries, job_queries]
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for part in _PARTS for k, s in part.ORACLE_SQL.items()}
