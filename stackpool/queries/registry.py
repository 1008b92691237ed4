"""Registered queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackpool.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``."""
    def add(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[key] = run
        if oracle:
            ORACLES[key] = " ".join(oracle.split("\n"))
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x, name: str | None = None, places: int = 6) -> Column:
    """Rounded (to six places unless said otherwise), without a negative zero."""
    name = name or (x if isinstance(x, str) else None)
    c = F.round((F.col(x) if isinstance(x, str) else x).cast("double"), places) + F.lit(0.0)
    return c.alias(name) if name else c


def d6(x: str, name: str | None = None, places: int = 6) -> str:
    """The same in SQL."""
    return f"round(cast({x} as double),{places})+0.0" + (f" as {name}" if name else "")
