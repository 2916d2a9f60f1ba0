"""Motion along a sequence: steps, stationary segments, passes, log attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .headings import heading_runs
from .ordered import (
    Ordered,
    following,
    ordinal,
    previous,
    running_sum,
)
from .quantiles import exact_quantiles


def camera_steps(poses: DataFrame, seq: str, index: str, centre: Sequence[str]) -> DataFrame:
    """Distance to the next frame, for frames whose next index exists."""
    here = F.struct(F.col(index).alias("i"), *[F.col(c).alias(c) for c in centre])
    nxt = F.col("_next")
    square = sum(((nxt[c] - F.col(c)) * (nxt[c] - F.col(c)) for c in centre), F.lit(0.0))
    return (
        Ordered(poses, [seq], [index]).add(_next=following(here)).df
        .where(nxt["i"] == F.col(index) + 1)
        .select(seq, index, F.sqrt(square).alias("step"))
    )


def stationary(steps: DataFrame, seq: str, threshold: float = 0.1) -> DataFrame:
    """Each step against the median of its sequence; stationary below a share of it."""
    med = exact_quantiles(steps, [seq], F.col("step"), {"median_step": 0.5}).drop("n")
    return steps.join(med, seq).withColumns({
        "ratio": F.try_divide(F.col("step"), F.col("median_step")),
        "stationary": F.col("step") < threshold * F.col("median_step"),
    })


def edge_runs(df: DataFrame, seq: str, order: str, flag: str) -> DataFrame:
    """Length of the leading and of the trailing run of a flag; they never share a row.

    The leading run ends before the first row without the flag, the trailing run starts after
    the last one; both need only that row's ordinal.
    """
    placed = Ordered(df, [seq], [order]).add(_o=ordinal()).df
    off = F.when(~F.col(flag), F.col("_o"))
    n = F.count(F.lit(1))
    return placed.groupBy(seq).agg(
        n.alias("n"),
        F.coalesce(F.min(off), n).alias("lead"),
        F.coalesce(n - 1 - F.max(off), F.lit(0)).alias("trail"),
    )


def edge_summary(steps: DataFrame, sizes: DataFrame, seq: str, index: str, threshold: float = 0.1) -> DataFrame:
    """Leading/trailing stationary steps and slow tail; blank unless every step is measured.

    ``sizes`` holds ``seq, n_frames``. Sequences with fewer than five steps are left out.
    """
    marked = stationary(steps, seq, threshold)
    med = F.col("median_step")
    facts = marked.groupBy(seq).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max("median_step").alias("median_step"),
        F.count_if("stationary").alias("below_tenth"),
        F.min(F.when(F.col("stationary"), F.col(index))).alias("first_below"),
        F.max(F.when(F.col("step") >= 0.5 * med, F.col(index))).alias("_fast"),
    )
    runs = edge_runs(marked, seq, index, "stationary").drop("n")
    full = F.col("n_steps") == F.col("n_frames") - 1
    tail = F.coalesce(F.col("_fast") + 1, F.lit(0))
    slow = full & (tail < F.col("n_frames") - 1)
    return (
        facts.where("n_steps >= 5").join(runs, seq).join(sizes, seq)
        .select(
            seq, "n_frames", "n_steps", full.alias("all_measured"), "median_step",
            F.when(full, F.col("lead")).alias("lead"),
            F.when(full, F.col("trail")).alias("trail"),
            "below_tenth", "first_below",
            F.when(slow, tail + 1).alias("slow_tail_first_frame"),
            F.when(slow, F.col("n_frames") - tail - 1).when(full, F.lit(0)).alias("slow_tail_frames"),
        )
    )


def moving_runs(odometry: DataFrame, seq: str, order: list[str], speed: str, fast: float = 0.4) -> DataFrame:
    """Rows above the speed, numbered by unbroken stretch (``stretch``)."""
    moving = F.col(speed) > fast
    return (
        Ordered(odometry, [seq], order)
        .add(ord=ordinal(), stretch=running_sum((~moving).cast("bigint")))
        .df.where(moving)
    )


def corridor_passes(
    odometry: DataFrame, seq: str, order: list[str], t: str, x: str, y: str, speed: str, yaw: str,
    fast: float = 0.4, turn: float = 15.0,
) -> DataFrame:
    """Runs above a speed whose heading stays near the heading of the run's first sample.

    A slow sample always ends a run, so unbroken moving stretches are independent; inside them the rule of
    the first heading is followed over blocks of samples (``headings``).
    """
    return heading_runs(moving_runs(odometry, seq, order, speed, fast), seq, t, x, y, speed, yaw, turn)


def pass_candidates(runs: DataFrame, min_duration: float = 10.0) -> DataFrame:
    """Duration, displacement, mean speed and their consistency of runs that last long enough."""
    dur, vmean = F.col("t1") - F.col("t0"), F.col("v_sum") / F.col("n")
    disp = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return (
        runs.withColumns({"dur": dur, "vmean": vmean, "disp": disp})
        .where(F.col("dur") >= min_duration)
        .withColumn("ratio", F.col("disp") / (F.col("vmean") * F.col("dur") + F.lit(1e-9)))
    )


def choose_pass(candidates: DataFrame, seq: str, lum: str, black: float = 8.0) -> DataFrame:
    """The longest candidate that is not dark; consistent ones (ratio 0.75–1.25) come first."""
    strict = F.col("ratio").between(0.75, 1.25)
    bright = candidates.where(F.col(lum) >= black).withColumn("strict", strict)
    rest = [c for c in bright.columns if c != seq]
    order = F.struct("strict", "dur", -F.col("t0"))
    return bright.groupBy(seq).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(seq, "_b.*")


def trim_window(odometry: DataFrame, windows: DataFrame, seq: str, t: str, speed: str, margin: float = 3.0, fast: float = 0.4) -> DataFrame:
    """First and last moving sample within the margin of each window, kept inside the margin."""
    low, high = F.col("t0") - margin, F.col("t1") + margin
    near = odometry.join(windows.select(seq, "t0", "t1"), seq).where(F.col(t).between(low, high))
    moving = F.when(F.col(speed) > fast, F.col(t))
    return near.groupBy(seq, "t0", "t1").agg(
        F.greatest(F.coalesce(F.min(moving), F.first(low)), F.first(low)).alias("ta"),
        F.least(F.coalesce(F.max(moving), F.first(high)), F.first(high)).alias("tb"),
    )


def recording_lag(rows: DataFrame, by: list[str], arrival: Column, event: Column, offset: Column) -> DataFrame:
    """Largest arrival minus event time (less a constant offset), at least 0."""
    return rows.groupBy(*by).agg(
        F.greatest(F.lit(0.0), F.max(arrival - (event - offset))).alias("lag")
    )


def log_attempts(log: DataFrame, run: str, line: str, start: Column, step: Column, discard: Column) -> DataFrame:
    """Attempts of a run: each ``start`` line opens one; later lines belong to the open attempt.

    ``discard`` is the reason a line gives, else null. The first reason of an attempt counts.
    """
    placed = (
        Ordered(log, [run], [line]).add(attempt=running_sum(start.cast("bigint"))).df
        .withColumns({"_start": start, "_step": step & ~start, "_reason": discard})
        .where("attempt > 0")
    )
    return placed.groupBy(run, "attempt").agg(
        F.min(F.when(F.col("_start"), F.col(line))).alias("first_line"),
        F.count_if(F.coalesce(F.col("_step"), F.lit(False))).alias("n_after"),
        F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col(line))).alias("discarded"),
    )


def attempt_summary(attempts: DataFrame, run: str) -> DataFrame:
    """First attempt and the one that registered most (the first of equals)."""
    best = F.max_by(F.struct("attempt", "n_after"), F.struct(F.col("n_after"), -F.col("attempt")))
    first = F.min_by(F.struct("attempt", "n_after"), F.col("attempt"))
    return attempts.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count("discarded").alias("n_discarded"),
        first.alias("_f"), best.alias("_b"),
    ).select(
        run, "n_attempts", "n_discarded", F.col("_f.n_after").alias("first_after"),
        F.col("_b.attempt").alias("best_attempt"), F.col("_b.n_after").alias("best_after"),
    )


def adjacent_groups(rows: DataFrame, by: list[str], order: list[str], group: str) -> DataFrame:
    """Number of the run of equal neighbours each row belongs to, from 1."""
    changed = F.col("_p").isNull() | (F.col("_p") != F.col(group))
    first = Ordered(rows, by, order).add(_p=previous(F.col(group)))
    return (
        first.map(lambda d: d.withColumn("_new", changed.cast("bigint")))
        .add(group_no=running_sum(F.col("_new")))
        .df.drop("_p", "_new")
    )


def path_length(poses: DataFrame, seq: str, order: list[str], centre: Sequence[str]) -> DataFrame:
    """Length of the camera path in order."""
    here = F.struct(*[F.col(c).alias(c) for c in centre])
    p = F.col("_p")
    square = sum(((p[c] - F.col(c)) * (p[c] - F.col(c)) for c in centre), F.lit(0.0))
    return (
        Ordered(poses, [seq], order).add(_p=previous(here)).df
        .groupBy(seq).agg(F.coalesce(F.sum(F.sqrt(square)), F.lit(0.0)).alias("path_len"))
    )

