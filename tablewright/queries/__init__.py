"""Registered queries: each is a Spark callable (spark, sf_dir) -> DataFrame
over the driver tables, paired with an equivalent DuckDB SQL text where one
exists.  ``__spark_entry__`` exposes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load_all() -> None:
    from tablewright.queries import (  # noqa: F401
        q_audit, q_prep, q_stats, q_eda, q_scalars, q_planning, q_eval, q_ml, q_catalog,
    )


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in _REGISTRY.items()}


def all_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1] is not None}
