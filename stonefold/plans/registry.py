"""Registration of queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from stonefold.sources.tables import duckdb_views


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle_sql: dict[str, str] = {}

    def __call__(self, oracle: str | None = None, *views: str) -> Callable:
        """Register a query; `oracle` is DuckDB SQL that may read the logical tables named."""

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if oracle:
                self.oracle_sql[f.__name__] = (duckdb_views(*views) + " " if views else "") + oracle
            return f

        return add
