"""Every operator as a query over the given tables, with the SQL that checks it."""

from driftkit.queries import checks, data, fleet, migration, schema  # noqa: F401
from driftkit.queries.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
