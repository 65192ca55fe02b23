"""Registered queries: name -> Spark callable, and name -> SQL on the same tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ("features", "portfolio", "diagnostics", "tradability", "ingest", "factors",
           "prospective", "registry", "ops", "modelling", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"barloom.plans.{m}")
