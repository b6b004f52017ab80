"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import SEEN, seen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its SQL."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def query_on(kind: str, key: str, name: str, sql: str):
    """Register a query on a table that parameters fix, joined to what the data holds at each row's ``key``."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            held = seen(spark, sf_dir, kind)
            return fn(spark, sf_dir).withColumn("_k", F.expr(key).cast("bigint")).join(held, F.col("_k") == F.col("k"), "left").drop("_k", "k").withColumn("seen", F.coalesce("seen", F.lit(0.0)))

        query(name, f"SELECT q.*, coalesce(m.seen, 0) AS seen FROM ({sql}) q LEFT JOIN ({SEEN[kind]}) m ON m.k = {key}")(run)
        return fn

    return add


def r6(x) -> Column:
    """Round to six decimals alike in both engines."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 1e6 + 0.5) / 1e6


def s6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"
