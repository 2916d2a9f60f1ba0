"""Registry of named queries, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .bindings import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Bound:
    """A registered query as the driver calls it: ``(spark, sf_dir) -> DataFrame``."""

    fn: Callable[[Tables], DataFrame]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.fn(Tables(spark, sf_dir))


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its oracle."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
