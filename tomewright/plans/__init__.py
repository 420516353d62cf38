"""Registered queries by family, each with the SQL that states its result."""

from . import catalog, flows, more, retrieval, text

FAMILIES = [retrieval, catalog, text, flows, more]


def queries() -> dict:
    return {k: v for f in FAMILIES for k, v in f.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for f in FAMILIES for k, v in f.ORACLE_SQL.items()}
