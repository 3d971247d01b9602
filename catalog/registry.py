"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.columns import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Results that are irrational, or whose summation order varies, are compared to six places."""
    return df.select([F.round(col(c), digits).alias(c) if c in names else col(c) for c in df.columns])


def r6(sql: str, digits: int = 6) -> str:
    return f"(ROUND({sql}, {digits}) + 0.0)"
