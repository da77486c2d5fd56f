"""Registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from tickloom.plans import bar_queries, blocked_queries, ingest_queries, source_queries, stream_queries, tick_queries, trade_queries

MODULES = [tick_queries, bar_queries, trade_queries, ingest_queries, stream_queries, blocked_queries, source_queries]
FLAGSHIP = "e2_realized_volatility"
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
