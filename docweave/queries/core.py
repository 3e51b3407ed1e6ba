"""The queries of the core and their SQL."""

from docweave.queries import documents, graph, nested, runs, scores

MODULES = (documents, graph, nested, scores, runs)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
