"""All queries of the engine by name, and the SQL that they equal."""

from __future__ import annotations

from .registry import QUERIES, SQL, Query


def _load() -> None:
    from . import assets, documents, exports, runs, traces, vectors, web  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
