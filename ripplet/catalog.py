"""The registry of queries and of the SQL that gives the same rows."""

from ripplet.plans import queries_ci, queries_graph, queries_history, queries_routing, queries_rules, queries_selection

QUERIES: dict = {**queries_graph.QUERIES, **queries_selection.QUERIES, **queries_history.QUERIES, **queries_ci.QUERIES, **queries_rules.QUERIES, **queries_routing.QUERIES}
ORACLES: dict = {**queries_graph.ORACLES, **queries_selection.ORACLES, **queries_history.ORACLES, **queries_ci.ORACLES, **queries_rules.ORACLES, **queries_routing.ORACLES}
