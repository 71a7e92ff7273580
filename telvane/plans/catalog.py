"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telvane.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package()
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(*columns: str, digits: int = 6, prefix: str = "") -> str:
    """SQL: the columns rounded under their own names."""
    return ", ".join(f"round({prefix}{c}, {digits}) AS {c}" for c in columns)


def load_all() -> None:
    from telvane.plans import (  # noqa: F401
        queries_alerts,
        queries_evaluate,
        queries_fusion,
        queries_harmonise,
        queries_models,
        queries_prep,
        queries_profile,
        queries_signals,
        queries_sources,
        queries_streams,
    )
