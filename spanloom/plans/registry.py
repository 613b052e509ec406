"""All registered queries over the trace model."""

from __future__ import annotations

from . import core_queries, service_queries
from .core_queries import flagship

QUERIES = {**core_queries.QUERIES, **service_queries.QUERIES}
ORACLE_SQL = {**core_queries.ORACLE_SQL, **service_queries.ORACLE_SQL}

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
