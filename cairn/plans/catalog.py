"""All core queries and their oracle SQL."""

from cairn.plans import admission, claims, core_problems, graph, lifecycle, proposals, records, retrieval, streams, upkeep

MODULES = (core_problems, records, claims, retrieval, streams, upkeep, proposals, admission, lifecycle, graph)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
