"""Registered queries over the fixture tables, each with its SQL."""

from . import documents, history, inputs, metadata, plans, retrieval

MODULES = (metadata, history, documents, retrieval, plans, inputs)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
