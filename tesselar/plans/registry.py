"""All registered queries on plan drawings, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselar.plans.fixtures import load, twin

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
MODULES = ("filters", "geometry", "joins", "summaries", "windows", "topology", "reviews", "files", "more", "gates", "manifest", "coverage")


def query(*tables: str, sql: str | None = None, name: str | None = None):
    """Registers a function of the named views under its own name."""

    def add(fn):
        key = name or fn.__name__
        _queries[key] = lambda spark, sf_dir: fn(*(load(spark, sf_dir, t) for t in tables))
        if sql:
            _sql[key] = twin(sql)
        return fn

    return add


def _all() -> None:
    for m in MODULES:
        importlib.import_module(f"tesselar.plans.{m}")


def queries() -> dict[str, Query]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_sql)
