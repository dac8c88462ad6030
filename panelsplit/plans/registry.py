"""Registry of driver queries: ``name -> (spark, sf_dir) -> DataFrame`` and
the matching DuckDB oracle SQL (omitted for rows-only checks)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .edge import finish

SEG = ["c_mktsegment"]
NAT = ["c_nationkey"]
CUST = ["o_custkey"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
