"""Where query modules register: a function of Views, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerstone.plans.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[Views], DataFrame], views: str = "", sql: str = "") -> None:
    """Register a query; without SQL its rows are tested against literal cases instead."""
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(views, sql)
