"""Pose geometry: baselines, coverage, spread, triangulation, alignment, view overlap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle_degrees, dot, minus, norm
from .ordered import Ordered, attach, following
from .quantiles import exact_quantiles
from .sequence import path_length
from .spatial import nearest

TINY = 1e-12


def triangulation_angle(obs: DataFrame, point: str, order: Sequence[str], xyz: str, centre: str, cap: int = 5) -> DataFrame:
    """Largest angle between rays to the first ``cap`` registered cameras of each point.

    At most ``cap`` cameras are kept per point (the row limit is applied before the shuffle), so
    the pairs are compared inside one short array.
    """
    w = Window.partitionBy(point).orderBy(*order)
    few = obs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
    rays = few.groupBy(point).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rn", minus(F.col(xyz), F.col(centre)).alias("r")))),
            lambda s: s["r"],
        ).alias("_r")
    )

    def angle(a: Column, b: Column) -> Column:
        return angle_degrees(dot(a, b) / (norm(a) * norm(b) + TINY))

    pairs = [
        F.when(F.size("_r") > j, angle(F.get("_r", F.lit(i)), F.get("_r", F.lit(j))))
        for i in range(cap) for j in range(i + 1, cap)
    ]
    best = F.array_max(F.array(*pairs))
    return rays.select(point, F.coalesce(best, F.lit(0.0)).alias("tri_angle"))


def median_step(poses: DataFrame, seq: str, order: Sequence[str], centre: Sequence[str]) -> DataFrame:
    here = F.struct(*[F.col(c).alias(c) for c in centre])
    nxt = F.col("_n")
    square = sum(((nxt[c] - F.col(c)) * (nxt[c] - F.col(c)) for c in centre), F.lit(0.0))
    steps = (
        Ordered(poses, [seq], order).add(_n=following(here)).df
        .where(nxt.isNotNull()).select(seq, F.sqrt(square).alias("_step"))
    )
    return exact_quantiles(steps, [seq], F.col("_step"), {"median_step": 0.5}).drop("n")


def axis_quantiles(points: DataFrame, by: Sequence[str], coords: Sequence[str], low: float, high: float) -> DataFrame:
    """Columns ``<coord>_lo`` and ``<coord>_hi`` per group, all axes in one pass."""
    long = points.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in coords])).alias("_a")
    ).select(*by, "_a.axis", "_a.v")
    ranks = exact_quantiles(long, [*by, "axis"], F.col("v"), {"lo": low, "hi": high})
    picks = [F.max(F.when(F.col("axis") == c, F.col(e))).alias(f"{c}_{e}") for c in coords for e in ("lo", "hi")]
    return (ranks.groupBy(*by) if by else ranks.groupBy()).agg(*picks)


def diagonal(box: Sequence[str]) -> Column:
    return F.sqrt(sum(((F.col(f"{c}_hi") - F.col(f"{c}_lo")) * (F.col(f"{c}_hi") - F.col(f"{c}_lo")) for c in box), F.lit(0.0)))


def baseline_fraction(poses: DataFrame, points: DataFrame, seq: str, order: Sequence[str], coords: Sequence[str]) -> DataFrame:
    """Median consecutive step over the diagonal of the 5–95 % box of the points."""
    box = axis_quantiles(points, [seq], coords, 0.05, 0.95)
    return attach(median_step(poses, seq, order, coords), box, [seq]).select(
        seq, (F.col("median_step") / (diagonal(coords) + TINY)).alias("baseline_frac")
    )


def lattice(count: int) -> np.ndarray:
    """Unit directions spread evenly on the sphere (a spiral of equal areas)."""
    i = np.arange(count)
    z = 1.0 - (2.0 * i + 1.0) / count
    phi = i * (np.pi * (3.0 - np.sqrt(5.0)))
    r = np.sqrt(1.0 - z * z)
    return np.column_stack([r * np.cos(phi), r * np.sin(phi), z])


def view_coverage(poses: DataFrame, seq: str, axis: Sequence[str], cap_deg: float = 15.0, directions: int = 20000) -> DataFrame:
    """Solid angle within ``cap_deg`` of any optical axis, in steradian.

    Every task marks the directions its rows cover (a fixed number of them per sequence), so
    what is shuffled does not grow with the poses.
    """
    kind = poses.schema[seq].dataType.simpleString()
    reach = float(np.cos(np.radians(cap_deg)))

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = lattice(directions)
        for pdf in batches:
            for key, part in pdf.groupby(seq, sort=False):
                seen = np.zeros(directions, bool)
                axes = part[list(axis)].to_numpy(float)
                axes = axes / np.maximum(np.linalg.norm(axes, axis=1, keepdims=True), TINY)
                for lo in range(0, len(axes), 512):
                    left = np.flatnonzero(~seen)
                    if not len(left):
                        break
                    seen[left] = (grid[left] @ axes[lo : lo + 512].T >= reach).any(axis=1)
                hit = np.flatnonzero(seen)
                yield pd.DataFrame({seq: np.repeat(key, len(hit)), "direction": hit})

    marks = poses.select(seq, *axis).mapInPandas(covered, f"{seq} {kind}, direction int")
    share = marks.distinct().groupBy(seq).agg(F.count(F.lit(1)).alias("_n"))
    full = poses.select(seq).distinct().join(share, seq, "left")
    return full.select(seq, (F.coalesce("_n", F.lit(0)) / float(directions) * 4.0 * float(np.pi)).alias("coverage_sr"))


def mean_vector(df: DataFrame, by: Sequence[str], axis: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in axis])


def view_spread(poses: DataFrame, seq: str, axis: Sequence[str], q: float = 0.9) -> DataFrame:
    """Percentile of the angle between each axis and the mean of the axes, all of unit length."""
    own = F.greatest(F.sqrt(sum((F.col(c) * F.col(c) for c in axis), F.lit(0.0))), F.lit(TINY))
    poses = poses.select(seq, *[(F.col(c) / own).alias(c) for c in axis])
    mean = mean_vector(poses, [seq], axis)
    length = F.sqrt(sum((F.col(f"{c}_mean") * F.col(f"{c}_mean") for c in axis), F.lit(0.0))) + TINY
    cosine = sum((F.col(c) * F.col(f"{c}_mean") for c in axis), F.lit(0.0)) / length
    return exact_quantiles(attach(poses, mean, [seq]), [seq], angle_degrees(cosine), {"spread": q}).drop("n")


def scene_scale(points: DataFrame, by: Sequence[str], coords: Sequence[str], q: float = 0.95) -> DataFrame:
    """Percentile of the distance from the centroid, at least 1e-6."""
    centred = attach(points, mean_vector(points, by, coords), list(by))
    away = F.sqrt(sum(((F.col(c) - F.col(f"{c}_mean")) * (F.col(c) - F.col(f"{c}_mean")) for c in coords), F.lit(0.0)))
    ranks = exact_quantiles(centred, by, away, {"scale": q})
    return ranks.select(*by, F.greatest(F.col("scale"), F.lit(1e-6)).alias("scale"))


def up_vector(poses: DataFrame, by: Sequence[str], up: Sequence[str], strict: bool = False) -> DataFrame:
    """Mean camera up, normalised; the y axis when its length is below 0.1 (or not above it)."""
    mean = mean_vector(poses, by, up)
    length = F.sqrt(sum((F.col(f"{c}_mean") * F.col(f"{c}_mean") for c in up), F.lit(0.0)))
    usable = length > 0.1 if strict else length >= 0.1
    fallback = [0.0, 1.0, 0.0]
    return mean.select(*by, *[
        F.when(usable, F.col(f"{c}_mean") / length).otherwise(F.lit(d)).alias(c) for c, d in zip(up, fallback)
    ])


def view_overlap(numbered: DataFrame, seq: str, view: str, centre: Sequence[str], axis: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Nearest training view of each held-out view (``held_out``): distance over path, angle."""
    held, train = numbered.where("held_out"), numbered.where("NOT held_out")
    pairs = nearest(held, train, [seq], centre, view, view).drop("rank")
    path = path_length(numbered, seq, order, centre)
    side = lambda df, p: df.select(seq, F.col(view).alias(p), F.array(*axis).alias(f"_{p}"))
    both = (
        pairs.withColumnRenamed("neighbour", "nn_view")
        .join(side(held, view), [seq, view]).join(side(train, "nn_view"), [seq, "nn_view"]).join(path, seq)
    )
    return both.select(
        seq, view, "nn_view",
        F.when(F.col("path_len") > 0, F.col("dist") / F.col("path_len")).alias("nn_dist_frac"),
        angle_degrees(dot(F.col(f"_{view}"), F.col("_nn_view"))).alias("nn_angle_deg"),
    )


def _fit(stats: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Scale, rotation and translation of each row's means, covariance and source variance."""
    mu_s = stats[["ms0", "ms1", "ms2"]].to_numpy(float)
    mu_d = stats[["md0", "md1", "md2"]].to_numpy(float)
    cov = stats[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy(float).reshape(-1, 3, 3)
    u, d, vt = np.linalg.svd(cov)
    mirror = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
    signs = np.column_stack([np.ones_like(mirror), np.ones_like(mirror), mirror])
    rot = (u * signs[:, None, :]) @ vt
    var = stats["var"].to_numpy(float)
    scale = np.divide((d * signs).sum(axis=1), var, out=np.zeros_like(var), where=var > 0)
    shift = mu_d - scale[:, None] * np.einsum("nij,nj->ni", rot, mu_s)
    return scale, rot, shift


def align_similarity(pairs: DataFrame, by: str, src: Sequence[str], dst: Sequence[str]) -> DataFrame:
    """Least-squares similarity of each group: ``scale, rot (9 values), shift (3 values), n``.

    Means and covariances are Spark aggregates; only one row per group meets NumPy.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(s).alias(f"ms{i}") for i, s in enumerate(src)]
    aggs += [F.avg(d).alias(f"md{i}") for i, d in enumerate(dst)]
    aggs += [F.covar_pop(d, s).alias(f"c{i}{j}") for i, d in enumerate(dst) for j, s in enumerate(src)]
    aggs += [(F.var_pop(src[0]) + F.var_pop(src[1]) + F.var_pop(src[2])).alias("var")]
    stats = pairs.groupBy(by).agg(*aggs)
    kind = stats.schema[by].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scale, rot, shift = _fit(pdf)
            yield pd.DataFrame({
                by: pdf[by], "n": pdf["n"], "scale": scale,
                "rot": list(rot.reshape(-1, 9)), "shift": list(shift),
            })

    return stats.mapInPandas(solve, f"{by} {kind}, n bigint, scale double, rot array<double>, shift array<double>")


def trajectory_error(pairs: DataFrame, by: str, src: Sequence[str], dst: Sequence[str], few: int = 8) -> DataFrame:
    """Root mean square distance after alignment; null below 4 pairs, flagged below ``few``."""
    fit = align_similarity(pairs, by, src, dst)
    moved = pairs.join(fit, by)
    square = F.lit(0.0)
    for i, d in enumerate(dst):
        turned = sum((F.get("rot", F.lit(3 * i + j)) * F.col(s) for j, s in enumerate(src)), F.lit(0.0))
        miss = F.col("scale") * turned + F.get("shift", F.lit(i)) - F.col(d)
        square = square + miss * miss
    out = moved.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_matched"), F.sqrt(F.avg(square)).alias("_e"), F.max("scale").alias("_s")
    )
    usable = F.col("n_matched") >= 4
    return out.select(
        by, "n_matched", F.when(usable, F.col("_e")).alias("ate_rmse"), F.when(usable, F.col("_s")).alias("scale"),
        F.when(usable & (F.col("n_matched") < few), "yes").otherwise("").alias("flagged"),
    )
