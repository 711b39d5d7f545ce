"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import gazetteer_queries, lookup_queries, pair_queries, place_queries, route_queries, snapshot_queries, source_queries, table_queries, text_queries, title_queries, view_queries

MODULES = (pair_queries, table_queries, text_queries, lookup_queries, place_queries, view_queries, source_queries, route_queries, title_queries, snapshot_queries, gazetteer_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
