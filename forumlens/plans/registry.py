"""Registry of named queries (Spark plan + optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` (string or zero-arg callable) is the oracle; omit it for operators
    that SQL cannot express (iterative or sequential ones)."""

    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules fills the registry.
    from forumlens.plans import (  # noqa: F401
        text_queries, outcome_queries, report_queries, graph_queries, model_queries, extract_queries,
        document_queries, record_queries,
    )


def queries() -> dict[str, Callable]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: (v() if callable(v) else v) for k, v in _ORACLE.items()}
