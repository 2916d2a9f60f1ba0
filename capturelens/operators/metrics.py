"""Plug-ins: metrics by name, conditions as rows of switches, preparers by kind."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

Builder = Callable[[], Column]
Table = Callable[[DataFrame, Sequence[str]], DataFrame]

AGGREGATES: dict[str, Builder] = {}
TABLES: dict[str, Table] = {}


def metric(name: str) -> Callable[[Builder], Builder]:
    """Register an aggregate column under a name; Spark keeps and merges its partial state."""

    def add(fn: Builder) -> Builder:
        AGGREGATES[name] = fn
        return fn

    return add


def table_metric(name: str) -> Callable[[Table], Table]:
    """Register a metric that needs its own plan (a percentile): ``(df, by) -> by, name``."""

    def add(fn: Table) -> Table:
        TABLES[name] = fn
        return fn

    return add


def compute(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """All named metrics per group; the aggregates share one pass."""
    unknown = [n for n in names if n not in AGGREGATES and n not in TABLES]
    if unknown:
        raise KeyError(f"unknown metrics: {unknown}")
    simple = [AGGREGATES[n]().alias(n) for n in names if n in AGGREGATES]
    base = df.groupBy(*by).agg(*simple) if simple else df.select(*by).distinct()
    out = reduce(lambda acc, n: acc.join(TABLES[n](df, by), list(by), "left"), [n for n in names if n in TABLES], base)
    return out.select(*by, *names)


for _m in ("psnr", "ssim", "lpips"):
    metric(f"{_m}_mean")(lambda m=_m: F.avg(m))
    metric(f"{_m}_std")(lambda m=_m: F.stddev_pop(m))
    metric(f"{_m}_max")(lambda m=_m: F.max(m))
    table_metric(f"{_m}_median")(
        lambda df, by, m=_m: exact_quantiles(df, by, F.col(m), {f"{m}_median": 0.5}).drop("n")
    )
metric("n_views")(lambda: F.count(F.lit(1)))


def with_conditions(df: DataFrame, name: str, conditions: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Each row once per condition, with the condition's switches as columns."""
    switches = F.array(*[
        F.struct(F.lit(c).alias(name), *[F.lit(v).alias(k) for k, v in s.items()]) for c, s in conditions.items()
    ])
    return df.withColumn("_c", F.explode(switches)).select("*", "_c.*").drop("_c")


def dispatch(df: DataFrame, kind: str, preparers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rows of each kind through the preparer of that kind; any other kind, null too, is an error."""
    unknown = F.raise_error(F.concat(F.lit("no preparer for kind: "), F.coalesce(F.col(kind).cast("string"), F.lit("null"))))
    checked = df.withColumn(kind, F.when(F.col(kind).isin(list(preparers)), F.col(kind)).otherwise(unknown))
    parts = [checked.where(F.col(kind) == k).transform(fn) for k, fn in preparers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
