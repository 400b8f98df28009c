"""Registered queries: one per operator group, each with its DuckDB twin.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle is ANSI SQL over
the raw test tables.  Floating outputs are rounded to 6 places on both
sides.  Queries whose result depends on Spark's hash functions or on a
fitted model have no oracle (rows-only check) and are tested against
invariants in ``tests/``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from driftwood.plans import (q_checks, q_drift, q_features, q_lineitem, q_metrics,  # noqa: F401
                                 q_models, q_preprocess, q_profile, q_runs, q_splits)
