"""Queries over the test tables, by name, each with its DuckDB equivalent where SQL can express it."""

from . import catalog, details, documents, filters, media, plan, shared, sources, streams, text, values, work

MODULES = [media, text, work, plan, sources, details, values, catalog, documents, filters, streams, shared]
QUERIES = {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
