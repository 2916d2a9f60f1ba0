"""Joins on time: interpolating as-of, nearest gap, interval overlap and containment.

As-of joins are one union and one ordered pass per clock (``Ordered``), so a long sequence is
spread over many tasks. Interval joins bucket time, so only rows that share a bucket meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, last_known, next_known


def _around(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, right_on: str, cols: Sequence[str]
) -> DataFrame:
    """Left rows with the samples of ``right`` at or before and at or after them."""
    sample = F.struct(F.col(right_on).cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in cols])
    own = F.struct(*[F.col(c) for c in left.columns])
    lhs = left.select(*by, F.col(on).cast("double").alias("_t"), F.lit(1).alias("_side"),
                      own.alias("_row"), F.xxhash64(own).alias("_tie"))
    rhs = right.where(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).cast("double").alias("_t"), F.lit(0).alias("_side"),
        sample.alias("_s"), F.xxhash64(sample).alias("_tie"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    placed = Ordered(both, by, ["_t", "_side", "_tie"]).add(
        _prev=last_known(F.col("_s")), _next=next_known(F.col("_s"))
    ).df
    return placed.where(F.col("_side") == 1).select("_row.*", "_prev", "_next")


def asof_interp(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    right_on: str,
    cols: Sequence[str],
    edges: str = "clamp",
    suffix: str = "",
) -> DataFrame:
    """``cols`` of ``right`` interpolated linearly to the time of each left row.

    ``edges='clamp'`` keeps the end value outside the sampled range, ``'drop'`` drops the row.
    Left rows of a group without samples get nulls (clamp) or go (drop).
    """
    placed = _around(left, right, by, on, right_on, cols)
    prev, nxt, t = F.col("_prev"), F.col("_next"), F.col(on).cast("double")
    # At an exact hit both neighbours may be samples of the same time: the earlier one counts.
    weight = F.when(nxt["t"] > prev["t"], (t - prev["t"]) / (nxt["t"] - prev["t"])).otherwise(0.0)

    def value(c: str) -> Column:
        blend = prev[c] + weight * (nxt[c] - prev[c])
        return F.when(prev.isNull(), nxt[c]).when(nxt.isNull(), prev[c]).otherwise(blend)

    inside = prev.isNotNull() & (nxt.isNotNull() | (prev["t"] == t))
    out = placed if edges == "clamp" else placed.where(inside)
    return out.select(*left.columns, *[value(c).alias(c + suffix) for c in cols])


def nearest_gap(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, right_on: str, name: str
) -> DataFrame:
    """Smallest absolute time difference of each left row to any right row of its group."""
    placed = _around(left, right, by, on, right_on, [])
    t = F.col(on).cast("double")
    gap = F.least(t - F.col("_prev.t"), F.col("_next.t") - t)  # least skips nulls
    return placed.select(*left.columns, gap.alias(name))


def _length_class(start: Column, end: Column, width: float) -> Column:
    """0 for lengths up to ``width``, one more for every doubling."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((end - start).cast("double") / width, F.lit(1.0))))).cast("int")


def _spread(df: DataFrame, start: Column, end: Column, width: float, classes: DataFrame) -> DataFrame:
    """Each interval once or twice in every length class from its own on: ``_own, _class, _bucket``.

    The buckets of a class are as wide as its longest interval, so none lies in more than two of them.
    """
    own = df.withColumn("_own", _length_class(start, end, width)).crossJoin(F.broadcast(classes))  # one row
    wider = own.withColumn("_class", F.explode(F.filter("_classes", lambda c: c >= F.col("_own")))).drop("_classes")
    return wider.withColumn("_bucket", F.explode(F.sequence(_bucket(start, width), F.greatest(_bucket(start, width), _bucket(end, width)))))


def _bucket(t: Column, width: float) -> Column:
    return F.floor(t / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_class")))).cast("bigint")


def _classes_of(*sides: tuple[DataFrame, Column, Column], width: float) -> DataFrame:
    """One row ``_classes``: the length classes that occur, a few dozen at most, as lengths double from one to the next."""
    found = [df.select(_length_class(start, end, width).alias("_c")) for df, start, end in sides]
    return reduce(DataFrame.union, found).agg(F.array_sort(F.collect_set("_c")).alias("_classes"))


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
) -> DataFrame:
    """Pairs of intervals of a group that overlap, with ``overlap``; each pair once.

    Both sides are spread over time buckets of the length class of the longer one, ``width`` being the
    narrowest; a pair is kept only in the first bucket the two share.
    """
    (a0, a1), (b0, b1) = left_span, right_span
    start = F.greatest(F.col(a0), F.col(b0))
    shared = F.least(F.col(a1), F.col(b1)) - start
    classes = _classes_of((left, F.col(a0), F.col(a1)), (right, F.col(b0), F.col(b1)), width=width)
    pairs = _spread(left, F.col(a0), F.col(a1), width, classes).withColumnRenamed("_own", "_left").join(
        _spread(right, F.col(b0), F.col(b1), width, classes), [*by, "_class", "_bucket"]
    )
    met = (F.col("_class") == F.greatest("_left", "_own")) & (_bucket(start, width) == F.col("_bucket"))
    return pairs.where((shared > 0) & met).withColumn("overlap", shared).drop("_left", "_own", "_class", "_bucket")


def overlap_best(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    left_key: str,
    width: float,
) -> DataFrame:
    """For each left interval the right interval it overlaps most (first in time on a tie)."""
    pairs = overlap_pairs(left, right, by, left_span, right_span, width)
    rest = [c for c in pairs.columns if c not in (*by, left_key)]
    best = F.max_by(F.struct(*rest), F.struct(F.col("overlap"), -F.col(right_span[0])))
    return pairs.groupBy(*by, left_key).agg(best.alias("_b")).select(*by, left_key, "_b.*")


def within_intervals(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    t: str,
    span: tuple[str, str],
    width: float,
) -> DataFrame:
    """Points inside a closed interval of their group; the interval's columns are attached."""
    classes = _classes_of((intervals, F.col(span[0]), F.col(span[1])), width=width)
    every = points.crossJoin(F.broadcast(classes)).withColumn("_class", F.explode("_classes")).drop("_classes")  # one row
    spread = _spread(intervals, F.col(span[0]), F.col(span[1]), width, classes).where("_class = _own").drop("_own")
    return (
        every.withColumn("_bucket", _bucket(F.col(t), width)).join(spread, [*by, "_class", "_bucket"])
        .where(F.col(t).between(F.col(span[0]), F.col(span[1])))
        .drop("_class", "_bucket")
    )


def share_within(df: DataFrame, by: Sequence[str], gap: str, limit: float) -> DataFrame:
    """Share of rows whose gap is below the limit, null gaps left out."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(gap) < limit).cast("double")).alias("share")
    )
