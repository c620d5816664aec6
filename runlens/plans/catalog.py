"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from runlens.plans import failure_queries, file_queries, history_queries, metric_queries, report_queries, stream_queries

_AREAS = (failure_queries, metric_queries, history_queries, file_queries, report_queries, stream_queries)

QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: text for area in _AREAS for name, text in area.ORACLES.items()}
