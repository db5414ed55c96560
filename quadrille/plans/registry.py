"""Named queries with their SQL; modules of this package register theirs on import."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("points", "roads", "network", "text", "scores", "records", "actions", "shapes", "streams", "checks", "evaluation")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
    return QUERIES, SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
