"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.sources.social import SQL

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Registers a (spark, sf_dir) function. ``sql`` follows the views: a SELECT, or ``, more AS (...) SELECT``."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = (SQL if views else "") + sql
        return f

    return keep
