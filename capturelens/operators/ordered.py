"""Ordered computations over long sequences, without putting a sequence into one task.

A window partitioned by the sequence sends a whole sequence to one task. When one sequence may
hold a third of all rows that task never ends. ``Ordered`` cuts the rows into *blocks*: ranges of
(sequence, order key), as many as the rows fill by the size of the files they come from. The ranged rows are written once to the shared
checkpoint folder together with their block numbers, so every step reads the same blocks, also
after an executor is lost. A windowed value is then the value inside the block, merged with what
earlier (or later) blocks of the same sequence carry over; the carry is computed on one row per
(sequence, block). Rows that fill one block have nothing to carry, and are not written. Nor are the rows
of sequences of which none is longer than a block: they are dealt by sequence, about a quarter of a block a task.

Null keys are keys like any other: they come first in the order and form a sequence of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import write_through

BLK = "_blk"
BLOCK_ROWS_CONF = "spark.capturelens.block.rows"
BLOCK_ROWS = 1_000_000  # rows of a block, about
ROW_BYTES = 16  # of the files behind a frame, for each of its rows
SHARES = 4  # tasks for the rows of a block that are dealt by sequence
BUCKETS = 2**14  # in which groups are counted together


def likely_rows(df: DataFrame) -> int:
    """About how many rows a frame has, by the size of the files it reads. No query runs, unless it also stands on
    rows whose size the planner does not know; then these are counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return df.count() if max(sizes, default=0) >= 2**60 else sum(sizes) // ROW_BYTES


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(BLOCK_ROWS)))


def short_groups(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether no group has more rows than a block. Groups are counted together in a fixed number of buckets, so a
    task sends a few counts only; a bucket that is too large for a block may do without cause, none is missed."""
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(BUCKETS)).alias("_bucket")
    counts = df.select(bucket).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    return (counts.agg(F.max("_n")).first()[0] or 0) <= block_rows(df.sparkSession)


def by_group(df: DataFrame, by: Sequence[str]) -> DataFrame | None:
    """The rows dealt by group for windows over whole groups, about a quarter of a block a task; None where a group may
    be longer than a block."""
    if not short_groups(df, by):
        return None
    blocks = max(1, -(-likely_rows(df) // block_rows(df.sparkSession)))
    return df.repartition(blocks * SHARES, *[F.col(c) for c in by]) if blocks > 1 else df


def dealt(by: Sequence[str], *frames: DataFrame, within: DataFrame | None = None) -> list[DataFrame]:
    """The frames dealt by the same keys, of which none repeats much, over as many tasks as leave each about a quarter of
    a block however many rows there are; as they are where one block holds them, or where a group of ``within`` may be
    longer than a block."""
    blocks = max(-(-likely_rows(df) // block_rows(df.sparkSession)) for df in frames)
    if blocks <= 1 or (within is not None and not short_groups(within, by)):
        return list(frames)
    return [df.repartition(blocks * SHARES, *[F.col(c) for c in by]) for df in frames]


def attach(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row of the frame with the totals of its group; null keys meet null keys."""
    renamed = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[c for c in totals.columns if c not in by]
    )
    met = F.lit(True)
    for i, k in enumerate(by):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(renamed, met, "left").drop(*[f"_k{i}" for i in range(len(by))])


@dataclass(frozen=True)
class Carried:
    """A windowed value: inside a block, per block, across blocks, and their merge."""

    local: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column] | None = None
    carry: Callable[[Column, WindowSpec], Column] | None = None
    merge: Callable[[Column, Column], Column] | None = None
    finish: Callable[[Column], Column] = lambda c: c


UPTO = (Window.unboundedPreceding, Window.currentRow)
FROM = (Window.currentRow, Window.unboundedFollowing)
BEFORE = (Window.unboundedPreceding, -1)
AFTER = (1, Window.unboundedFollowing)
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def ordinal() -> Carried:
    """0-based position in the sequence."""
    return Carried(
        lambda w: F.row_number().over(w).cast("bigint") - 1,
        lambda key: F.count(F.lit(1)),
        lambda s, w: F.coalesce(F.sum(s).over(w.rowsBetween(*BEFORE)), F.lit(0)),
        lambda a, b: a + b,
    )


def running_sum(value: Column) -> Carried:
    """Sum of all rows up to and including this one."""
    return Carried(
        lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(*UPTO)), F.lit(0)),
        lambda key: F.sum(value),
        lambda s, w: F.coalesce(F.sum(s).over(w.rowsBetween(*BEFORE)), F.lit(0)),
        lambda a, b: a + b,
    )


def running_max(value: Column, backwards: bool = False) -> Carried:
    """Largest value so far, or from here to the end when ``backwards``."""
    inside, outside = (FROM, AFTER) if backwards else (UPTO, BEFORE)
    return Carried(
        lambda w: F.max(value).over(w.rowsBetween(*inside)),
        lambda key: F.max(value),
        lambda s, w: F.max(s).over(w.rowsBetween(*outside)),
        lambda a, b: F.greatest(a, b),
    )


def group_total(value: Column) -> Carried:
    """Sum over the whole sequence, on every row."""
    return Carried(
        lambda w: F.sum(value).over(w.rowsBetween(*WHOLE)),
        lambda key: F.sum(value),
        lambda s, w: F.sum(s).over(w.rowsBetween(*WHOLE)),
        lambda a, b: b,
    )


def previous(value: Column) -> Carried:
    """Value of the row before, null on the first row."""
    box = F.struct(value.alias("v"))
    return Carried(
        lambda w: F.lag(box).over(w),
        lambda key: F.max_by(box, key),
        lambda s, w: F.lag(s).over(w),
        lambda a, b: F.coalesce(a, b),
        lambda c: c.getField("v"),
    )


def following(value: Column) -> Carried:
    """Value of the row after, null on the last row."""
    box = F.struct(value.alias("v"))
    return Carried(
        lambda w: F.lead(box).over(w),
        lambda key: F.min_by(box, key),
        lambda s, w: F.lead(s).over(w),
        lambda a, b: F.coalesce(a, b),
        lambda c: c.getField("v"),
    )


def last_known(value: Column) -> Carried:
    """Last non-null value at or before the row."""
    return Carried(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(*UPTO)),
        lambda key: F.max_by(value, F.when(value.isNotNull(), key)),
        lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(*BEFORE)),
        lambda a, b: F.coalesce(a, b),
    )


def next_known(value: Column) -> Carried:
    """First non-null value at or after the row."""
    return Carried(
        lambda w: F.first(value, ignorenulls=True).over(w.rowsBetween(*FROM)),
        lambda key: F.min_by(value, F.when(value.isNotNull(), key)),
        lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(*AFTER)),
        lambda a, b: F.coalesce(a, b),
    )


class Ordered:
    """A frame of sequences in order, ready for windowed values.

    ``within`` is a frame whose groups are at least as long and that costs less to count.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], within: DataFrame | None = None):
        self.by, self.order = list(by), list(order)
        keys = [F.col(c) for c in self.by + self.order]
        self.blocks = max(1, -(-likely_rows(df.select(*keys)) // block_rows(df.sparkSession)))
        self._read_once, self._df = True, df
        if self.split and self.by and short_groups(df if within is None else within, self.by):
            self._df = df.repartition(self.blocks * SHARES, *[F.col(c) for c in self.by])
            self.blocks = 1
        if self.split:
            ranged = df.repartitionByRange(self.blocks, *keys).withColumn(BLK, F.spark_partition_id())
            self._df = write_through(ranged, "blocks")

    @property
    def split(self) -> bool:
        return self.blocks > 1

    @property
    def df(self) -> DataFrame:
        return self._df.drop(BLK)

    def _next(self, df: DataFrame, read_once: bool) -> Ordered:
        out = object.__new__(Ordered)
        out.by, out.order, out.blocks = self.by, self.order, self.blocks
        out._df, out._read_once = df, read_once
        return out

    def add(self, **values: Carried) -> Ordered:
        """The same frame with one more column per windowed value."""
        if not self.split:
            w = Window.partitionBy(*self.by).orderBy(*self.order)
            return self._next(
                self._df.select("*", *[v.finish(v.local(w)).alias(name) for name, v in values.items()]), True
            )
        # what is added to joined blocks reads them twice, so they are written first
        rows = self._df if self._read_once else write_through(self._df, "blocks")
        keys = [*self.by, BLK]
        w = Window.partitionBy(*keys).orderBy(*self.order)
        local = rows.select("*", *[v.local(w).alias(f"_in_{n}") for n, v in values.items()])
        key = F.struct(*[F.col(c) for c in self.order])
        summary = rows.groupBy(*keys).agg(
            *[v.summary(key).alias(f"_s_{n}") for n, v in values.items()]
        )
        ws = Window.partitionBy(*self.by).orderBy(BLK)
        carried = summary.select(
            *keys, *[v.carry(F.col(f"_s_{n}"), ws).alias(f"_c_{n}") for n, v in values.items()]
        )
        return self._next(
            attach(local, carried, keys).select(
                *rows.columns,
                *[
                    v.finish(v.merge(F.col(f"_in_{n}"), F.col(f"_c_{n}"))).alias(n)
                    for n, v in values.items()
                ],
            ),
            False,
        )

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Change columns row by row; the order and the blocks stay."""
        return self._next(fn(self._df), self._read_once)


def with_totals(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row by partial aggregation and a join back."""
    return attach(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]), by)
