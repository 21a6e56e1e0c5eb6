"""Name -> callable(spark, sf_dir) registry used by __spark_entry__ and bench."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    """Register ``fn``; the registered callable first applies the session settings
    the library relies on (UTC wall clock, AQE with skew join), so it behaves
    the same in a session built elsewhere."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from shopstream.session import configure
            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return fn
    return deco
