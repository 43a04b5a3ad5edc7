"""All queries over the given tables, by name, with their SQL counterparts."""

from __future__ import annotations

from panelyard.plans import case_queries, channel_queries, cross_queries, entry_queries, epoch_queries, join_queries, policy_queries, search_queries, single_queries, stream_queries, walk_queries, window_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (window_queries, cross_queries, join_queries, search_queries, policy_queries, walk_queries, single_queries, entry_queries, case_queries, channel_queries, epoch_queries, stream_queries):
    if _twice := QUERIES.keys() & _part.QUERIES.keys():
        raise ValueError(f"queries of one name: {sorted(_twice)}")
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
