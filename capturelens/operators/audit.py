"""Audit of report cells: every registered cell is worked out again by another route and compared as text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARES = 1_000_000


@dataclass(frozen=True)
class Registered:
    """Cells of a report: its rows, their key, the columns to check, and rows with the same key and columns that were
    worked out from the raw tables in another way."""

    report: str
    rows: DataFrame
    key: str
    cells: Sequence[str]
    again: DataFrame


def cell_texts(report: str, rows: DataFrame, key: str, cells: Sequence[str], text: str) -> DataFrame:
    """``report, key`` and the texts of a row's cells as one array; a null cell has no text."""
    return rows.select(F.lit(report).alias("report"), F.col(key).cast("string").alias("key"), F.array(*[F.col(c).cast("string") for c in cells]).alias(text))


def picked(share: float, seed: int) -> Column:
    """Cells chosen by the hash of their name, the same in the report and in what is worked out again."""
    return F.pmod(F.xxhash64("report", "key", "cell", F.lit(seed)), F.lit(SHARES)) < round(share * SHARES)


def audit(registry: Sequence[Registered], share: float = 1.0, seed: int = 0) -> DataFrame:
    """``report, key, cell, reported, recomputed, agrees`` for the chosen share of all cells, in one frame.

    A row that one side lacks does not agree, nor does one that a side holds twice; two null cells do. Null keys
    meet null keys.
    """
    reported = reduce(DataFrame.union, [cell_texts(r.report, r.rows, r.key, r.cells, "reported") for r in registry])
    again = reduce(DataFrame.union, [cell_texts(r.report, r.again, r.key, r.cells, "recomputed") for r in registry])
    both = reported.unionByName(again, allowMissingColumns=True)
    # a row's cells meet together, and are listed only then
    each = range(max((len(r.cells) for r in registry), default=0))
    sides = both.groupBy("report", "key").agg(
        F.count("reported").alias("n_reported"), F.count("recomputed").alias("n_recomputed"),
        *[F.max(F.get(side, F.lit(i))).alias(f"{side}_{i}") for side in ("reported", "recomputed") for i in each])
    listed = F.lit(None).cast("array<struct<cell:string,reported:string,recomputed:string>>")
    for r in registry:
        texts = [F.struct(F.lit(c).alias("cell"), F.col(f"reported_{i}").alias("reported"), F.col(f"recomputed_{i}").alias("recomputed")) for i, c in enumerate(r.cells)]
        listed = F.when(F.col("report") == r.report, F.array(*texts)).otherwise(listed)
    once = (F.col("n_reported") == 1) & (F.col("n_recomputed") == 1)
    cells = sides.select("report", "key", once.alias("once"), F.explode(listed).alias("c")).select("report", "key", "once", "c.*")
    return cells.where(picked(share, seed)).select(
        "report", "key", "cell", "reported", "recomputed", (F.col("once") & F.col("reported").eqNullSafe(F.col("recomputed"))).alias("agrees"))


def audit_summary(cells: DataFrame) -> DataFrame:
    """``report, cells, differing`` of an audit."""
    return cells.groupBy("report").agg(F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("agrees")).alias("differing"))
