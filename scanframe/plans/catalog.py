"""Registry of the core library's queries and their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanframe.plans import views

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("discovery", "tabular", "volumes", "remaps", "augment", "manifold", "linear", "analysis", "io")
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, needs: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register f, which gets the DataFrames of the tables or views named in needs; sql: the same rows in DuckDB."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(*[views.frame(spark, sf_dir, n) for n in needs.split()])
        if sql is not None:
            _ORACLE[name] = views.oracle(sql)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"scanframe.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cov_metrics"](spark, sf_dir)
