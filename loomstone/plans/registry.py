"""Every registered query of the library and its SQL for an independent engine."""

from __future__ import annotations

from . import keyspace_queries, log_queries, memory_queries, streaming_queries, vector_queries

_ALL = {**vector_queries.QUERIES, **memory_queries.QUERIES, **keyspace_queries.QUERIES, **log_queries.QUERIES, **streaming_queries.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
