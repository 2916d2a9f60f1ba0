"""Exact linear-interpolation percentiles that do not hold a group in one task.

Equal values are counted first (partial aggregation), the distinct values are ranked in blocks
and only the one or two values around each requested rank reach the last aggregate. Spark's own
``percentile`` keeps all distinct values of a group in one buffer; it is used elsewhere in this
library only where a group is bounded by construction (the pixels of a frame, 200 sampled
frames).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, group_total, running_sum


def rank_values(
    df: DataFrame, by: Sequence[str], value: Column, fractions: Mapping[str, float], ends: bool = False
) -> DataFrame:
    """Per group ``n`` and, for each fraction, the values at the ranks around it and the weight.

    With ``ends`` also ``v_min, v_max`` and the number of rows ``total``, nulls among them.
    """
    counted = df.select(*by, value.alias("_v")).groupBy(*by, "_v").agg(
        F.count("_v").alias("_c"), *([F.count(F.lit(1)).alias("_rows")] if ends else [])
    )  # nulls count nothing, but a group of nulls stays a group
    keyed = counted if by else counted.withColumn("_all", F.lit(0))
    ranked = Ordered(keyed, by or ["_all"], ["_v"], df if by else None).add(
        _cum=running_sum(F.col("_c")), _n=group_total(F.col("_c"))
    ).df
    picks = []
    for name, q in fractions.items():
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        start = F.col("_cum") - F.col("_c")
        picks += [
            F.max(F.when((start <= lo) & (F.col("_cum") > lo), F.col("_v"))).alias(f"{name}_lo"),
            F.max(F.when((start <= hi) & (F.col("_cum") > hi), F.col("_v"))).alias(f"{name}_hi"),
            F.max(pos - lo).alias(f"{name}_w"),
        ]
    if ends:
        picks += [F.min("_v").alias("v_min"), F.max("_v").alias("v_max"), F.sum("_rows").alias("total")]
    out = ranked.groupBy(*by) if by else ranked.groupBy()
    return out.agg(F.max("_n").alias("n"), *picks)


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: Column, fractions: Mapping[str, float]
) -> DataFrame:
    """Columns ``by``, ``n`` and one double per named fraction (NumPy's linear rule)."""
    ranked = rank_values(df, by, value, fractions)
    return ranked.select(
        *by,
        "n",
        *[
            (
                F.col(f"{n}_lo").cast("double")
                + (F.col(f"{n}_hi") - F.col(f"{n}_lo")).cast("double") * F.col(f"{n}_w")
            ).alias(n)
            for n in fractions
        ],
    )


def exact_median_decimal(df: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """Median in decimal arithmetic, as report cells need it, with ``n, v_min, v_max, total``."""
    ranked = rank_values(df, by, value.cast("decimal(28,10)"), {name: 0.5}, ends=True)
    half = ((F.col(f"{name}_lo") + F.col(f"{name}_hi")) / F.lit(2)).cast("decimal(28,11)")
    return ranked.select(*by, "n", "v_min", "v_max", "total", half.alias(name))
