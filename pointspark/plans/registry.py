"""Where queries and their SQL are registered."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"registered twice: {key}")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add
