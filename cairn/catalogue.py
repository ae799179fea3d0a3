"""Every registered query with its DuckDB oracle."""

from __future__ import annotations

from cairn.plans import corpus_queries, event_queries, evidence_queries, read_queries, record_queries, store_queries, support_queries

FLAGSHIP = "events_page"
AREAS = (event_queries.area, corpus_queries.area, record_queries.area, evidence_queries.area, support_queries.area, read_queries.area, store_queries.area)
QUERIES: dict = {name: f for area in AREAS for name, f in area.queries.items()}
ORACLES: dict[str, str] = {name: text for area in AREAS for name, text in area.oracles.items()}
