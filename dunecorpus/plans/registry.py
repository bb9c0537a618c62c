"""All queries on the reference's operators, with the SQL that they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("cleaning", "counting", "labelling", "selecting", "modelling", "connecting", "filtering", "evaluating", "classifying", "language", "growing")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _queries[name] = f
    if sql:
        _sql[name] = sql


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def put(f):
        add(f.__name__, f, sql)
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"dunecorpus.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q0_clean_profile"](spark, sf_dir)
