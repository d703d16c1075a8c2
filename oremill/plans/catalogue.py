"""All queries over the driver's tables, by name, and their SQL oracles."""

from __future__ import annotations

from . import evidence_queries, history_queries, operation_queries, run_queries, stream_queries

QUERIES: dict = {**evidence_queries.QUERIES, **operation_queries.QUERIES, **run_queries.QUERIES, **stream_queries.QUERIES, **history_queries.QUERIES}
ORACLES: dict = {**evidence_queries.ORACLES, **operation_queries.ORACLES, **run_queries.ORACLES, **stream_queries.ORACLES, **history_queries.ORACLES}
