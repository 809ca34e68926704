"""Registry of named queries: each is ``f(spark, sf_dir) -> DataFrame`` built
from the operators over the canonical chat tables, with its DuckDB oracle.

Parameters (``as_of`` instants, thresholds) are fixed here so the Spark query
and the oracle SQL agree; they are scaled to the synthetic data (events are
sparse, the reference's production limits would never trip).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def _load_all() -> None:
    # Importing the query modules fills the registry.
    from . import q_feedback, q_history, q_tasks, q_text, q_streams, q_vectors, q_quality, q_training, q_rows  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
