"""Registered queries and their oracle statements."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ballast.testbed import Testbed, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(testbed) -> DataFrame`` under a name, with the SQL that must agree with it."""

    def register(fn: Callable[[Testbed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Testbed(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = duckdb_sql(oracle)
        return fn

    return register


def load_all() -> None:
    import ballast.checks as package

    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{package.__name__}.{module.name}")
