"""All registered queries over the driver's tables, with their SQL."""

from . import action_queries, audit_queries, code_queries, context_queries, graph_queries, stream_queries, text_queries, usage_queries

_FAMILIES = [usage_queries, text_queries, graph_queries, audit_queries, code_queries, stream_queries, action_queries, context_queries]
QUERIES: dict = {}
ORACLES: dict = {}
for _family in _FAMILIES:
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
