"""Registry of named queries: each is a Spark job over the given tables plus,
where the semantics are deterministic, the same query as DuckDB-runnable SQL.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, sql text | None)``
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # importing the modules fills the registry
    from . import q_core, q_scorers, q_kernels, q_text, q_report, q_sources, q_words, q_models, q_vectors, q_matrix, q_pooling  # noqa: F401
    return QUERIES
