"""Registered queries and their oracle SQL."""

from __future__ import annotations

from terralith.plans import element_queries, failure_queries, footprint_queries, network_queries, panel_queries, place_queries, source_queries

network_queries.add_ball_queries()

QUERIES: dict = {**element_queries.Q, **footprint_queries.Q, **network_queries.Q, **place_queries.Q, **panel_queries.Q, **source_queries.Q, **failure_queries.Q}
ORACLES: dict = {**element_queries.O, **footprint_queries.O, **network_queries.O, **place_queries.O, **panel_queries.O, **source_queries.O, **failure_queries.O}
