"""All queries of the core library and their SQL."""

from quarrylens.plans import code_queries, event_queries, funnel_queries, graph_queries, static_queries, syntax_queries

_PARTS = (code_queries, graph_queries, funnel_queries, event_queries, static_queries, syntax_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE: dict = {k: v for part in _PARTS for k, v in part.ORACLE.items()}
