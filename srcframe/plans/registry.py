"""Registry of named queries: each operator of the inventory has a Spark
query ``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, a
DuckDB SQL twin over the driver's tables (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn`` under ``name`` with optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from srcframe.plans import (callgraph_q, diagrams_q, endpoints_q, facts_q, javalogs_q, logs_q,  # noqa: F401
                                project_q, scalars_q, sensitive_q, soap_q, sqlops_q, structure_q, wsdl_q)
