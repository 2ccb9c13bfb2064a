"""Where the query modules put their queries."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with the SQL that gives the same rows."""

    def put(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return put
