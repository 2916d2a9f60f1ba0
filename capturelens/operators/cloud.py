"""Point clouds and camera sets: thinning, clipping, centres, axes, projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, group_total, ordinal
from .pose import axis_quantiles
from .quantiles import exact_quantiles


def seeded_sample(points: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """The ``count`` points with the smallest seeded hash; the same points on every run."""
    return points.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(count)


def voxel_downsample(points: DataFrame, by: Sequence[str], coords: Sequence[str], size: float, colours: Sequence[str] = ()) -> DataFrame:
    """One mean point (and colour) per cell."""
    cells = {f"g_{c}": F.floor(F.col(c) / size).cast("bigint") for c in coords}
    return points.withColumns(cells).groupBy(*by, *cells).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in (*coords, *colours)]
    )


def logistic(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def prune_opacity(points: DataFrame, logit: str, least: float) -> DataFrame:
    return points.where(logistic(F.col(logit)) >= least)


def percentile_clip(points: DataFrame, by: Sequence[str], coords: Sequence[str], pad: float, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Points inside the padded percentile box of their group on every axis."""
    box = axis_quantiles(points, by, coords, low, high)
    boxed = points.join(box, list(by)) if by else points.crossJoin(F.broadcast(box))  # one row
    for c in coords:
        room = (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * pad
        boxed = boxed.where(F.col(c).between(F.col(f"{c}_lo") - room, F.col(f"{c}_hi") + room))
    return boxed.select(*points.columns)


def dense_centre(points: DataFrame, by: Sequence[str], coords: Sequence[str], logit: str, q: float = 0.4) -> DataFrame:
    """Mean of the points above an opacity percentile, and the 5–95 % extent of all points."""
    cut = exact_quantiles(points, by, logistic(F.col(logit)), {"_cut": q}).drop("n")
    dense = points.join(cut, list(by)).where(logistic(F.col(logit)) > F.col("_cut"))
    centre = dense.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_centre") for c in coords])
    box = axis_quantiles(points, by, coords, 0.05, 0.95)
    return centre.join(box, list(by)).select(
        *by, *[f"{c}_centre" for c in coords],
        *[(F.col(f"{c}_hi") - F.col(f"{c}_lo")).alias(f"{c}_extent") for c in coords],
    )


def robust_centre(points: DataFrame, by: Sequence[str], coords: Sequence[str], fov_deg: float = 70.0, margin: float = 1.25) -> DataFrame:
    """Centre and extent of the 10–90 % box and the distance that fits it into the view."""
    box = axis_quantiles(points, by, coords, 0.1, 0.9)
    size = {c: F.col(f"{c}_hi") - F.col(f"{c}_lo") for c in coords}
    fit = lambda half: half / F.tan(F.radians(F.lit(fov_deg / 2))) * margin
    return box.select(
        *by,
        *[((F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2).alias(f"{c}_centre") for c in coords],
        *[size[c].alias(f"{c}_extent") for c in coords],
        fit(F.greatest(size[coords[0]], size[coords[2]]) / 2).alias("dist_top"),
        fit(F.greatest(*size.values()) / 2).alias("dist_side"),
    )


def principal_axis(points: DataFrame, by: str, coords: Sequence[str]) -> DataFrame:
    """Direction of largest variance per group, turned so that z is not negative."""
    names = [f"c{i}{j}" for i in range(3) for j in range(3)]
    stats = points.groupBy(by).agg(*[
        F.covar_pop(a, b).alias(f"c{i}{j}") for i, a in enumerate(coords) for j, b in enumerate(coords)
    ])
    kind = stats.schema[by].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, vectors = np.linalg.eigh(pdf[names].to_numpy(float).reshape(-1, 3, 3))
            top = vectors[:, :, 2]
            top = np.where(top[:, 2:] < 0, -top, top)
            yield pd.DataFrame({by: pdf[by], "ax": top[:, 0], "ay": top[:, 1], "az": top[:, 2]})

    return stats.mapInPandas(solve, f"{by} {kind}, ax double, ay double, az double")


def order_cameras(cameras: DataFrame, axes: DataFrame, by: str, coords: Sequence[str], axis: Sequence[str], camera: str) -> DataFrame:
    """Cameras ordered by their projection on the group's axis; adds ``place`` and ``n``."""
    along = sum((F.col(c) * F.col(a) for c, a in zip(coords, axis)), F.lit(0.0))
    placed = cameras.join(axes, by).withColumn("along", along)
    return Ordered(placed, [by], ["along", camera]).add(
        place=ordinal(), n=group_total(F.lit(1).cast("bigint"))
    ).df


def pick_fractions(ordered: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """Cameras at ``int(f * (n - 1))`` of the order, one row per fraction."""
    wanted = F.filter(
        F.array(*[F.lit(float(f)) for f in fractions]),
        lambda f: F.floor(f * (F.col("n") - 1)) == F.col("place"),
    )
    return ordered.withColumn("fraction", F.explode(wanted))


def project_pinhole(points: DataFrame, by: Sequence[str], point: str, camera_xyz: Sequence[Column], width: int, height: int, fov_deg: float, margin: int = 0) -> DataFrame:
    """Pixel of each point in front of the camera; the nearest point wins a pixel.

    ``camera_xyz`` are the coordinates in the camera frame (z forward).
    """
    focal = width / (2.0 * np.tan(np.radians(fov_deg / 2)))
    x, y, z = camera_xyz
    seen = points.withColumns({"_z": z, "_px": focal * x / z + width / 2.0, "_py": focal * y / z + height / 2.0}).where(
        (F.col("_z") > 0.1)
        & (F.col("_px") >= margin) & (F.col("_px") < width - margin)
        & (F.col("_py") >= margin) & (F.col("_py") < height - margin)
    )
    pixel = seen.withColumns({"px": F.floor("_px").cast("bigint"), "py": F.floor("_py").cast("bigint")})
    return pixel.groupBy(*by, "px", "py").agg(
        F.min_by(point, F.struct(F.col("_z"), F.col(point))).alias(point), F.min("_z").alias("depth"),
        F.count(F.lit(1)).alias("n"),
    )


def excluded_box(keep: Column, width: int, pad: float = 0.15) -> Column:
    """Padded box of the excluded pixels of a row-major mask array; the whole image when none.

    ``keep`` is an array of booleans; all four sides come from array functions, nothing is
    exploded or shuffled.
    """
    height = F.floor(F.size(keep) / width)
    out = F.filter(F.sequence(F.lit(0), F.size(keep) - 1), lambda i: ~F.get(keep, i))
    xs, ys = F.transform(out, lambda i: i % width), F.transform(out, lambda i: F.floor(i / width))
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    px, py = F.floor((x1 - x0) * pad), F.floor((y1 - y0) * pad)
    big = lambda c: c.cast("bigint")
    none = F.size(out) == 0
    return F.struct(
        F.when(none, big(F.lit(0))).otherwise(F.greatest(big(F.lit(0)), big(x0 - px))).alias("x0"),
        F.when(none, big(F.lit(0))).otherwise(F.greatest(big(F.lit(0)), big(y0 - py))).alias("y0"),
        F.when(none, big(F.lit(width))).otherwise(F.least(big(F.lit(width)), big(x1 + px))).alias("x1"),
        F.when(none, big(height)).otherwise(F.least(big(height), big(y1 + py))).alias("y1"),
    )
