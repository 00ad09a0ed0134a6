"""Registry of named queries and their SQL oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the given tables (or the
fixture views Spark derives from them). ``register`` keeps the DuckDB SQL next
to the Spark query it checks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelens.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from codelens.plans import (  # noqa: F401
        q_bayes,
        q_html,
        q_io,
        q_judge,
        q_ml,
        q_neighbours,
        q_reconcile,
        q_taxonomy,
        q_text,
        q_tfidf,
    )
