"""Roll-ups of runs, seeds, conditions and annotations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import DASH, as_decimal, half_up, shown_range
from .ordered import Ordered, attach, group_total, ordinal
from .quantiles import exact_median_decimal, exact_quantiles

PARTS = ["n", "total", "low", "high"]


def median_range(df: DataFrame, by: Sequence[str], value: Column, kind: str, name: str) -> DataFrame:
    """Cell text ``median [min–max] (n = k)`` over the values that are determined."""
    keyed = df.select(*by, as_decimal(value).cast("decimal(28,10)").alias("_v"))
    ranked = exact_median_decimal(keyed, by, F.col("_v"), "_mid")
    cell = shown_range(*[F.col(c) for c in ("_mid", "v_min", "v_max", "n", "total")], kind)
    return ranked.select(*by, cell.alias(name))


def mean_range(value: Column, digits: int) -> Column:
    """Aggregate: cell text ``mean [min–max]``; the bracket goes for a single value."""
    return _mean_cell(*_mean_facts(value), digits)


def _mean_facts(value: Column) -> list[Column]:
    v = as_decimal(value).cast("decimal(28,10)")
    return [F.count(v), F.sum(v), F.min(v), F.max(v)]


def _mean_cell(n: Column, total: Column, low: Column, high: Column, digits: int) -> Column:
    mean = (total / n).cast("decimal(38,12)")
    ends = F.concat(F.lit(" ["), half_up(low, digits), F.lit("–"), half_up(high, digits), F.lit("]"))
    return F.when(n == 0, DASH).otherwise(F.concat(half_up(mean, digits), F.when(n > 1, ends).otherwise("")))


def mean_parts(value: Column, name: str) -> Column:
    """Aggregate: what ``mean_range`` needs of a part of a group's rows. Sums are decimals, so parts add up exactly."""
    return F.struct(*[c.alias(k) for k, c in zip(PARTS, _mean_facts(value))]).alias(name)


def mean_of_parts(parts: Column, digits: int) -> Column:
    """Aggregate: ``mean_range`` over the rows of all parts; null where no part is given."""
    n, total, low, high = (f(parts[k]) for k, f in zip(PARTS, (F.sum, F.sum, F.min, F.max)))
    return F.when(n.isNotNull(), _mean_cell(n, total, low, high, digits))


def repeat_summary(
    runs: DataFrame, by: str, order: str, registered: str, success: Column, pairs: Mapping[str, Column]
) -> DataFrame:
    """Per condition: runs, successes, rate, registered median/min/max, distinct initial pairs.

    A missing count is 0. A missing pair is one more distinct value.
    """
    counted = runs.withColumns(
        {"_reg": F.coalesce(F.col(registered), F.lit(0)), "_ok": F.coalesce(success, F.lit(False))}
    )
    n = F.count(F.lit(1))
    facts = counted.groupBy(by).agg(
        n.alias("n"), F.count_if("_ok").alias("success_count"),
        F.round(F.count_if("_ok") / n, 3).alias("success_rate"),
        F.min("_reg").alias("registered_min"), F.max("_reg").alias("registered_max"),
    )
    med = exact_quantiles(counted, [by], F.col("_reg"), {"registered_median": 0.5}).drop("n")
    out = attach(facts, med, [by])
    for name, pair in pairs.items():
        # Distinct in two steps, so that one condition with most runs is spread over tasks.
        kinds = counted.select(by, F.coalesce(pair.cast("string"), F.lit("\0")).alias("_p")).distinct()
        out = attach(out, kinds.groupBy(by).agg(F.count(F.lit(1)).alias(name)), [by])
    return out


def mean_sd(values: Mapping[str, Column], sample: bool = False) -> list[Column]:
    """Aggregates ``x_mean`` and ``x_std``: population deviation, or sample (null for one value)."""
    out = []
    for name, v in values.items():
        sd = F.when(F.count(v) > 1, F.stddev_samp(v)) if sample else F.stddev_pop(v)
        out += [F.avg(v).alias(f"{name}_mean"), sd.alias(f"{name}_std")]
    return out


def pivot_runs(runs: DataFrame, by: Sequence[str], run: str, numbers: Sequence[int], values: Sequence[str]) -> DataFrame:
    """Runs side by side with mean, sample deviation and counts; a missing run is ``pending``.

    One aggregate with a filter per run number: no pivot discovery, no second shuffle.
    """
    at = [
        F.max(F.when(F.col(run) == r, F.col(v))).alias(f"{v}_run{r}")
        for v in values for r in numbers
    ]
    status = [
        F.when(F.count_if(F.col(run) == r) > 0, "done").otherwise("pending").alias(f"status_run{r}")
        for r in numbers
    ]
    wanted = runs.where(F.col(run).isin(list(numbers)))
    return wanted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs_done"), *at, *status,
        *mean_sd({v: F.col(v) for v in values}, sample=True),
    )


def comparator(views: DataFrame, arm: Sequence[str], seed: str, values: Sequence[str], shared: Column) -> DataFrame:
    """Min, mean and max over seeds of the per-seed means on the shared views."""
    per_seed = views.where(shared).groupBy(*arm, seed).agg(*[F.avg(v).alias(v) for v in values])
    ends = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return per_seed.groupBy(*arm).agg(F.count(F.lit(1)).alias("n_seeds"), *ends)


def most_common(df: DataFrame, by: Sequence[str], value: str, order: Column) -> DataFrame:
    """Most frequent value of each group; of equals the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")
    )
    return counts.groupBy(*by).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value), F.max("_n").alias("n")
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Map of value to count; rows are counted before any of them is collected."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(value), F.col("_n"))))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias(name))


def distinct_in_order(df: DataFrame, by: Sequence[str], value: str, order: Column, name: str, sep: str = ", ") -> DataFrame:
    """Distinct values of a group, in the order they are first seen, as text."""
    firsts = df.groupBy(*by, value).agg(F.min(order).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", F.col(value).cast("string").alias("v"))))
    return firsts.groupBy(*by).agg(F.array_join(F.transform(listed, lambda s: s["v"]), sep).alias(name))


def first_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group on an order, by partial aggregation."""
    rest = [c for c in df.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*by).agg(first.alias("_r")).select(*by, "_r.*")


def pick_view(views: DataFrame, run: str, view: str, score: str, rule: str) -> DataFrame:
    """Best view, the upper middle view by score, or the first whose name starts with ``rule``."""
    if rule == "best":
        return first_row(views, [run], [-F.col(score), F.col(view)])
    if rule == "median":
        placed = Ordered(views, [run], [score, view]).add(
            _o=ordinal(), _n=group_total(F.lit(1).cast("bigint"))
        ).df
        return placed.where(F.col("_o") == F.floor(F.col("_n") / 2)).drop("_o", "_n")
    named = views.where(F.col(view).cast("string").startswith(rule))
    return first_row(named, [run], [F.col(view)])


def flag_phrases(rows: DataFrame, by: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """``flag value (n of N)`` phrases of a group; values that say "no" are not shown.

    No annotated row at all reads "not annotated", annotated without findings "none annotated".
    """
    total = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(F.coalesce(*[F.col(f) for f in flags]).isNotNull()).alias("_seen"),
    )
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(f).alias("flag"), F.col(f).cast("string").alias("value"))
        for i, f in enumerate(flags)
    ]))
    counts = (
        rows.select(*by, pairs.alias("_p")).select(*by, "_p.*")
        .where(F.col("value").isNotNull() & (F.col("value") != "no"))
        .groupBy(*by, "i", "flag", "value").agg(F.count(F.lit(1)).alias("_n"))
    )
    one = F.concat_ws(" ", "flag", "value")
    text = F.when(F.col("_total") > 1, F.concat(one, F.lit(" ("), F.col("_n").cast("string"), F.lit(" of "), F.col("_total").cast("string"), F.lit(")"))).otherwise(one)
    shown = (
        counts.join(total, list(by)).withColumn("_t", text).groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("i", "value", "_t"))).alias("_l"))
    )
    phrase = F.array_join(F.transform("_l", lambda s: s["_t"]), ", ")
    return total.join(shown, list(by), "left").select(
        *by,
        F.when(F.col("_seen") == 0, "not annotated")
        .otherwise(F.coalesce(phrase, F.lit("none annotated"))).alias("phrase"),
    )
