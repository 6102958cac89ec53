"""Registered queries and their check queries."""

from ebbtide.registry import checks, exploration, measures, modeling, preparation, warehouse

_PARTS = (warehouse, exploration, preparation, measures, modeling, checks)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
