"""Named queries, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", *, recursive: bool = False):
    """Registers a function (spark, sf_dir) under a name; the SQL may use the views that are named, in order."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            parts = [f"{v} as ({SQL_VIEWS[v]})" for v in views.split()]
            ORACLE_SQL[name] = (f"with {'recursive ' if recursive else ''}{', '.join(parts)} " if parts else "") + sql.strip()
        return f

    return put
