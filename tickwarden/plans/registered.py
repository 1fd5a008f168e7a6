"""All registered queries of the telemetry domain."""

from __future__ import annotations

from . import audit_queries, context_queries, queries, replay_queries

__all__ = ["ORACLE", "QUERIES", "audit_queries", "context_queries", "replay_queries"]

QUERIES, ORACLE = queries.QUERIES, queries.ORACLE
