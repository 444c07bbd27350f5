"""Registry of the reference's queries and their SQL twins."""

from __future__ import annotations

from . import audit_queries, evidence_queries, findings_queries, library_queries, program_queries, source_queries, strategy_queries, stream_queries, table_queries

_PARTS = (findings_queries, table_queries, strategy_queries, source_queries, audit_queries, library_queries, evidence_queries, stream_queries, program_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
