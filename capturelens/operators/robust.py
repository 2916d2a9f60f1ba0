"""Robust outlier scores of track observations and their pooled threshold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .ordered import attach, by_group, short_groups, with_totals
from .quantiles import exact_quantiles

MAD_SCALE = 1.4826  # fixed value: MAD to standard deviation of a normal distribution
VEIL_FLOOR = 0.02  # fixed value: smallest deviation of value and saturation
LAB_FLOORS = {"l": 1.0, "a": 0.3, "b": 0.3}  # fixed values: smallest deviation per Lab channel


def long_tracks(obs: DataFrame, point: str, least: int = 3, in_bounds: Column | None = None) -> DataFrame:
    """Observations of points seen often enough, before and after the bounds check."""
    dealt, n = by_group(obs, [point]), F.count(F.lit(1))

    def often(rows: DataFrame) -> DataFrame:
        counted = with_totals(rows, [point], _n=n) if dealt is None else rows.withColumn("_n", n.over(Window.partitionBy(point)))
        return counted.where(F.col("_n") >= least).drop("_n")

    tall = often(obs if dealt is None else dealt)
    return tall if in_bounds is None else often(tall.where(in_bounds))


def _channel_medians(obs: DataFrame, point: str, values: Mapping[str, Column], prefix: str) -> DataFrame:
    """One row per point with the median of every channel; all channels are ranked in one pass."""
    long = obs.select(point, F.explode(F.array(*[
        F.struct(F.lit(ch).alias("ch"), v.cast("double").alias("v")) for ch, v in values.items()
    ])).alias("_c")).select(point, "_c.ch", "_c.v")
    ranks = exact_quantiles(long, [point, "ch"], F.col("v"), {"_q": 0.5})
    return ranks.groupBy(point).agg(*[
        F.max(F.when(F.col("ch") == ch, F.col("_q"))).alias(f"{prefix}{ch}") for ch in values
    ])


def _with_medians(obs: DataFrame, point: str, values: Mapping[str, Column], prefix: str) -> DataFrame:
    """The rows with the median of every channel of their point, whose rows are in one task."""
    whole = Window.partitionBy(point)
    named = obs.withColumns({f"_v_{ch}": v.cast("double") for ch, v in values.items()})
    placed = named.withColumns({f"_n_{ch}": F.count(f"_v_{ch}").over(whole) for ch in values}).withColumns({
        f"_r_{ch}": F.row_number().over(whole.orderBy(F.col(f"_v_{ch}").asc_nulls_last())) - 1 for ch in values})
    half = {ch: (F.col(f"_n_{ch}") - 1) * 0.5 for ch in values}
    at = lambda ch, rank: F.max(F.when(F.col(f"_r_{ch}") == rank, F.col(f"_v_{ch}"))).over(whole)
    around = placed.withColumns({
        f"_{end}_{ch}": at(ch, rank(half[ch])) for ch in values for end, rank in (("lo", F.floor), ("hi", F.ceil))})
    return around.withColumns({
        f"{prefix}{ch}": F.col(f"_lo_{ch}") + (F.col(f"_hi_{ch}") - F.col(f"_lo_{ch}")) * (half[ch] - F.floor(half[ch])) for ch in values
    }).drop(*[f"_{x}_{ch}" for x in ("v", "n", "r", "lo", "hi") for ch in values])


def mad_z(obs: DataFrame, point: str, floors: Mapping[str, float]) -> DataFrame:
    """Adds ``z_<channel>``: distance to the point's median over its MAD, the MAD floored.

    Points of at most a block of rows are ranked where their rows are; where one has more, in blocks.
    """
    away = {ch: F.abs(F.col(ch) - F.col(f"_med_{ch}")) for ch in floors}
    if short_groups(obs, [point]):
        both = _with_medians(_with_medians(obs, point, {ch: F.col(ch) for ch in floors}, "_med_"), point, away, "_mad_")
    else:
        centred = attach(obs, _channel_medians(obs, point, {ch: F.col(ch) for ch in floors}, "_med_"), [point])
        both = attach(centred, _channel_medians(centred, point, away, "_mad_"), [point])
    return both.withColumns({
        f"z_{ch}": (F.col(ch) - F.col(f"_med_{ch}")) / F.greatest(MAD_SCALE * F.col(f"_mad_{ch}"), F.lit(floor))
        for ch, floor in floors.items()
    }).drop(*[f"_{m}_{ch}" for ch in floors for m in ("med", "mad")])


def veil_score(obs: DataFrame, point: str, value: str, saturation: str) -> DataFrame:
    """Adds ``score``: brighter and less saturated than the point's other observations."""
    scored = mad_z(obs, point, {value: VEIL_FLOOR, saturation: VEIL_FLOOR})
    zero = F.lit(0.0)
    return scored.withColumn(
        "score", F.greatest(F.col(f"z_{value}"), zero) + F.greatest(-F.col(f"z_{saturation}"), zero)
    )


def colour_score(obs: DataFrame, point: str, floors: Mapping[str, float]) -> DataFrame:
    """Adds ``score``: distance over all channels, in any direction."""
    scored = mad_z(obs, point, floors)
    total = sum((F.col(f"z_{c}") * F.col(f"z_{c}") for c in floors), F.lit(0.0))
    return scored.withColumn("score", F.sqrt(total))


def otsu_threshold(scores: DataFrame, score: str) -> DataFrame:
    """One row: the threshold of largest between-class variance over 256 bins of the maximum.

    The scores are written once, as they are read twice. Only the 256-bin histogram is windowed. All-zero scores give 0.
    """
    return _threshold(write_through(scores.select(score), "scores"), score)


def _threshold(scores: DataFrame, score: str) -> DataFrame:
    top = scores.agg(F.max(score).alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.floor(F.col(score) / F.col("_top") * 255)).otherwise(0)
    hist = (
        scores.join(F.broadcast(top))  # one row
        .groupBy(F.least(F.greatest(scaled, F.lit(0)), F.lit(255)).cast("int").alias("bin"), "_top")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("w") * F.col("bin")
    sums = hist.select(
        "bin", "_top", F.sum("w").over(upto).alias("w0"), F.sum(mass).over(upto).alias("m0"),
        F.sum("w").over(whole).alias("wt"), F.sum(mass).over(whole).alias("mt"),
    )
    w1 = F.col("wt") - F.col("w0")
    apart = F.col("m0") / F.col("w0") - F.try_divide(F.col("mt") - F.col("m0"), w1)
    between = F.when(w1 > 0, F.col("w0") * w1 * apart * apart).otherwise(0.0)
    best = sums.withColumn("_b", F.round(between, 6)).agg(
        F.max_by("bin", F.struct(F.col("_b"), -F.col("bin"))).alias("bin"), F.max("_top").alias("_top")
    )
    return best.select((F.col("bin") / 255.0 * F.col("_top")).alias("threshold"))


def flag_outliers(scores: DataFrame, score: str) -> DataFrame:
    """Adds ``threshold`` and ``flagged`` (above it); the scores are written once, as they are read three times."""
    scores = write_through(scores, "scores")
    return scores.join(F.broadcast(_threshold(scores, score))).withColumn(
        "flagged", F.col(score) > F.col("threshold")
    )


def robust_limits(df: DataFrame, by: list[str], value: Column, sigmas: float = 3.0) -> DataFrame:
    """Median plus and minus a number of population deviations."""
    sd = df.groupBy(*by).agg(F.stddev_pop(value).alias("_sd"))
    med = exact_quantiles(df, by, value, {"_med": 0.5})
    both = attach(med, sd, by) if by else med.crossJoin(sd)  # without groups both are one row
    return both.select(
        *by, (F.col("_med") - sigmas * F.col("_sd")).alias("lo"), (F.col("_med") + sigmas * F.col("_sd")).alias("hi")
    )
