"""Frame sampling, requirement sweeps and hold-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, attach, following, group_total, ordinal, running_sum
from .quantiles import exact_quantiles

MAX_FRAMES = 200  # fixed value: frames kept per sequence
TARGET_FPS = 2.0  # fixed value: frames per second aimed at
TARGET_WIDTH = 1600  # fixed value: image width aimed at, in pixels
BLACK_LUM = 8.0  # fixed value: mean luminance below which a frame is black


def number_frames(frames: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """Adds ``ord`` (0-based) and ``n_total`` per sequence."""
    return (
        Ordered(frames, [seq], order)
        .add(ord=ordinal(), n_total=group_total(F.lit(1).cast("bigint")))
        .df
    )


def stride(n_total: Column, fps: Column | None = None, cap: int = MAX_FRAMES) -> Column:
    """Sampling step: total over the cap, rate over the target rate (half to even), at least 1."""
    rate = F.bround(fps / TARGET_FPS).cast("bigint") if fps is not None else F.lit(0)
    by_count = F.floor(n_total / cap).cast("bigint")
    return F.greatest(by_count, F.coalesce(rate, F.lit(0)).cast("bigint"), F.lit(1).cast("bigint"))


def sample_stride(
    frames: DataFrame, seq: str, order: list[str], fps: str | None = None, cap: int = MAX_FRAMES
) -> DataFrame:
    """Frames 0, k, 2k, … of each sequence, the first ``cap`` of them; adds ``ord, n_total, k``."""
    numbered = number_frames(frames, seq, order)
    step = stride(F.col("n_total"), F.col(fps) if fps else None, cap)
    keep = (F.col("ord") % F.col("k") == 0) & (F.floor(F.col("ord") / F.col("k")) < cap)
    return numbered.withColumn("k", step).where(keep)


def video_step(n_total: Column, source_fps: Column, fps: float, cap: int) -> Column:
    """Step of a video: rate over target, widened to total over cap when still over the cap."""
    step = F.greatest(F.bround(source_fps / fps).cast("bigint"), F.lit(1).cast("bigint"))
    wide = F.greatest(F.floor(n_total / cap).cast("bigint"), F.lit(1).cast("bigint"))
    return F.when(F.floor(n_total / step) > cap, wide).otherwise(step)


def sample_video(
    frames: DataFrame, seq: str, order: list[str], source_fps: Column, fps: float, cap: int
) -> DataFrame:
    numbered = number_frames(frames, seq, order).withColumn(
        "step", video_step(F.col("n_total"), source_fps, fps, cap)
    )
    keep = (F.col("ord") % F.col("step") == 0) & (F.floor(F.col("ord") / F.col("step")) < cap)
    return numbered.where(keep)


def sample_sweep(
    frames: DataFrame,
    seq: str,
    order: list[str],
    fps: Column,
    levels: list[tuple[str, float]],
    target_fps: float = TARGET_FPS,
    width: int = TARGET_WIDTH,
) -> DataFrame:
    """One sample of every sequence per sweep level: ``fps``, ``width`` or ``count``.

    The levels are a short list of settings; each frame is tested against each of them in place.
    """
    options = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(float(v)).alias("value")) for k, v in levels]
    )
    big = lambda c: c.cast("bigint")
    rate = F.col("_fps")

    def step(level: Column) -> Column:
        target = F.when(level["kind"] == "fps", level["value"]).otherwise(F.lit(target_fps))
        return F.greatest(big(F.bround(rate / target)), big(F.lit(1)))

    def wanted(level: Column) -> Column:
        k = step(level)
        cap = F.when(level["kind"] == "count", big(level["value"]))
        short = cap.isNull() | (F.floor(F.col("ord") / k) < cap)
        return (F.col("ord") % k == 0) & short

    # A frame is repeated only for the levels that keep it.
    numbered = number_frames(frames, seq, order).withColumn("_fps", fps)
    kept = numbered.withColumn("_level", F.explode(F.filter(options, wanted)))
    level = F.col("_level")
    target_width = F.when(level["kind"] == "width", big(level["value"])).otherwise(F.lit(width))
    return kept.select(
        "*", level["kind"].alias("kind"), level["value"].alias("value"), step(level).alias("k"),
        big(target_width).alias("width"),
    ).drop("_fps", "_level")


def span_and_rate(first: Column, last: Column, fps: Column, k: Column) -> dict[str, Column]:
    """Span in seconds, effective rate and frame spacing after sampling."""
    return {
        "span_s": F.try_divide((last - first).cast("double"), fps),
        "fps_actual": F.try_divide(fps, k.cast("double")),
        "frame_spacing_s": F.try_divide(k.cast("double"), fps),
    }


def observed_rate(frames: DataFrame, seq: str, t_seconds: Column) -> DataFrame:
    """Frames per second of a stream; null for a single frame."""
    n, span = F.count(F.lit(1)), F.max(t_seconds) - F.min(t_seconds)
    return frames.groupBy(seq).agg(
        n.alias("n"), F.when(n > 1, F.try_divide((n - 1).cast("double"), span)).alias("fps")
    )


def fit_width(w: Column, h: Column, width: int = TARGET_WIDTH) -> Column:
    """Dimensions at a target width, never enlarged, height half to even."""
    height = F.bround(h * F.lit(float(width)) / w).cast("bigint")
    return F.struct(
        F.least(w.cast("bigint"), F.lit(width).cast("bigint")).alias("w"),
        F.when(w <= width, h.cast("bigint")).otherwise(height).alias("h"),
    )


def fit_longest(w: Column, h: Column, max_dim: int) -> Column:
    """Dimensions with the longer side brought down to ``max_dim``."""
    scale = F.least(F.lit(1.0), F.lit(float(max_dim)) / F.greatest(h, w))
    shrink = lambda c: F.when(scale < 1, F.bround(c * scale).cast("bigint")).otherwise(c.cast("bigint"))
    return F.struct(shrink(w).alias("w"), shrink(h).alias("h"))


def even_subsample(frames: DataFrame, seq: str, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` frames at a fractional step: positions ``round(i * n / cap)``."""
    numbered = number_frames(frames, seq, order)
    step = F.col("n_total") / F.lit(float(cap))
    near = F.floor(F.col("ord") / step).cast("bigint")
    # A frame is picked when it is the rounded position of some i; only i near ord/step can be.
    hits = F.array(*[near + d for d in (-1, 0, 1, 2)])
    wanted = F.exists(
        hits,
        lambda i: (i >= 0) & (i < cap) & (F.bround(i.cast("double") * step) == F.col("ord")),
    )
    return numbered.where((F.col("n_total") <= cap) | wanted)


def evenly_spaced(frames: DataFrame, seq: str, order: list[str], count: int = 10) -> DataFrame:
    """At most ``count`` frames at truncated, evenly spaced positions from first to last."""
    numbered = number_frames(frames, seq, order)
    m = F.least(F.col("n_total"), F.lit(count).cast("bigint"))
    last = F.col("n_total") - 1
    place = lambda i: F.when(
        i == m - 1, last
    ).otherwise(F.floor(i.cast("double") * (last.cast("double") / (m - 1))).cast("bigint"))
    return numbered.where(
        (m == 1) | F.exists(F.sequence(F.lit(0).cast("bigint"), m - 1), lambda i: place(i) == F.col("ord"))
    )


def split_interp(numbered: DataFrame, every: int = 8) -> DataFrame:
    """Marks every ``every``-th frame from ordinal 0 as held out."""
    return numbered.withColumn("held_out", F.col("ord") % every == 0)


def split_block(
    numbered: DataFrame, size: int = 4, start: int = 16, every: int = 32, short: int = 36
) -> DataFrame:
    """Marks blocks of frames as held out; short sequences hold out their middle frames."""
    ord_, n = F.col("ord"), F.col("n_total")
    middle = F.floor(n / 2).cast("bigint") - 2
    offset = F.pmod(ord_ - start, F.lit(every))
    block = (ord_ >= start) & (offset < size) & (ord_ - offset + size < n)
    held = F.when(n < short, (ord_ >= middle) & (ord_ < middle + size)).otherwise(block)
    return numbered.withColumn("held_out", held)


def split_trimmed(numbered: DataFrame, index: Column, keep_before: Column, every: int = 8) -> DataFrame:
    """Every ``every``-th frame whose frame index lies before the trim."""
    return numbered.withColumn("held_out", (F.col("ord") % every == 0) & (index < keep_before))


def content_profile(
    frames: DataFrame, seq: str, value: str, below: float, black: float = BLACK_LUM
) -> DataFrame:
    """Median, p10/p50/p90, share below a threshold, population deviation, black share."""
    v = F.col(value)
    shares = frames.groupBy(seq).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.avg((v < below).cast("double")).alias("share_below"),
        F.stddev_pop(v).alias("sigma"),
        F.avg((v < black).cast("double")).alias("black_share"),
    )
    ranks = exact_quantiles(frames, [seq], v, {"p10": 0.1, "p50": 0.5, "p90": 0.9}).drop("n")
    return attach(shares, ranks, [seq])


def sampling_interval(frames: DataFrame, seq: str, order: list[str], t_seconds: Column) -> DataFrame:
    """Median gap between consecutive rows and its rate, for more than two rows."""
    gaps = (
        Ordered(frames, [seq], order).add(_next=following(t_seconds)).df
        .select(seq, (F.col("_next") - t_seconds).alias("_gap"))
    )
    mid = exact_quantiles(gaps, [seq], F.col("_gap"), {"dt": 0.5})
    dt = F.when(F.col("n") >= 2, F.col("dt"))
    return mid.select(
        seq, (F.col("n") + 1).alias("n"), dt.alias("dt"), F.when(dt > 0, 1.0 / dt).alias("rate")
    )


def elapsed(frames: DataFrame, seq: str, t_seconds: Column) -> DataFrame:
    """Seconds since the first sample of the sequence."""
    firsts = frames.groupBy(seq).agg(F.min(t_seconds).alias("_t0"))
    return frames.join(firsts, seq).withColumn("elapsed_s", t_seconds - F.col("_t0")).drop("_t0")


def global_index(parts: DataFrame, seq: str, part_order: list[str], n: str) -> DataFrame:
    """Offset of each part so that its frames continue the numbering of the part before."""
    return (
        Ordered(parts, [seq], part_order).add(_cum=running_sum(F.col(n))).df
        .withColumn("offset", F.col("_cum") - F.col(n)).drop("_cum")
    )


