"""Registered queries of the retrieval, graph and analytics operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codequery.plans import expected, functions, graph, index, mining, retrieval, sources

_MODULES = (retrieval, graph, mining, functions, index, sources)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in (*_MODULES, expected) for name, sql in m.oracle_sql().items()}
