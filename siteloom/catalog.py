"""Registered queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteloom.plans import crawl_queries, run_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return crawl_queries.QUERIES | run_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return crawl_queries.ORACLES | run_queries.ORACLES
