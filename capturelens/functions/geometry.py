"""Angles, positions, camera poses and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0  # fixed value: WGS-84 equatorial radius
FILM_DIAGONAL_MM = 43.27  # fixed value: diagonal of the 35 mm film frame
HARMONIC_C0 = 0.28209479177387814  # fixed value: order-0 real spherical harmonic


def yaw_degrees(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def heading_difference(a: Column, b: Column) -> Column:
    """Absolute difference of two headings, wrapped to [0, 180]."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def dms_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and hemisphere letter as signed degrees."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def focal_px(
    focal_mm: Column, resolution: Column, unit: Column, focal35: Column, w: Column, h: Column
) -> Column:
    """Documented focal length in pixels: sensor resolution first, else 35 mm equivalent."""
    per_mm = (
        F.when(unit == 3, resolution / 10.0).when(unit == 4, resolution).otherwise(resolution / 25.4)
    )
    film = F.when(focal35 > 0, focal35 / FILM_DIAGONAL_MM * F.hypot(w, h))
    return F.when(focal_mm.isNotNull() & resolution.isNotNull(), focal_mm * per_mm).otherwise(film)


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> Column:
    """East, north, up in metres around an origin; up is 0 when an altitude is missing."""
    east = F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0))
    north = F.radians(lat - lat0) * EARTH_RADIUS_M
    up = F.coalesce(alt - alt0, F.lit(0.0))
    return F.struct(east.alias("east"), north.alias("north"), up.alias("up"))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of the same short length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x, norm(a)))


def angle_degrees(cosine: Column) -> Column:
    """Angle of a cosine, clipped against rounding."""
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def mat_vec(rows: Column, v: Column) -> Column:
    """Matrix (array of rows) times vector."""
    return F.transform(rows, lambda r: dot(r, v))


def transpose3(rows: Column) -> Column:
    column = lambda i: F.transform(rows, lambda r: r[i])
    return F.array(*[column(i) for i in range(3)])


def camera_centre(rotation: Column, translation: Column) -> Column:
    """Camera centre of world-to-camera extrinsics: minus transposed rotation times translation."""
    return F.transform(mat_vec(transpose3(rotation), translation), lambda x: -x)


def camera_to_world(rotation: Column, translation: Column) -> Column:
    """Camera-to-world 4x4 with y up in the camera and z up in the world, as an array of rows.

    The inverse of a rigid transform is its transposed rotation with the camera centre; the
    camera's y and z axes and the world's z axis are then turned round and the world's y and z
    rows change places.
    """
    back, centre = transpose3(rotation), camera_centre(rotation, translation)
    row = lambda i: F.array(back[i][0], -back[i][1], -back[i][2], centre[i])
    down = F.transform(row(1), lambda x: -x)
    last = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    return F.array(row(0), row(2), down, last)


def apply_affine(matrix: Column, point: Column) -> Column:
    """A 3x4 (or the top of a 4x4) matrix applied to a point."""
    return F.transform(
        F.slice(matrix, 1, 3), lambda r: dot(F.slice(r, 1, 3), point) + r[3]
    )


def harmonic_from_colour(rgb: Column) -> Column:
    return F.transform(rgb, lambda c: (c - 0.5) / HARMONIC_C0)


def colour_from_harmonic(coeff: Column) -> Column:
    return F.transform(coeff, lambda c: F.least(F.greatest(c * HARMONIC_C0 + 0.5, F.lit(0.0)), F.lit(1.0)))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue on 0–180 and saturation and value on 0–255, from 8-bit channels."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = high - low
    sector = (
        F.when(spread == 0, 0.0)
        .when(high == r, 60.0 * (g - b) / spread)
        .when(high == g, 120.0 + 60.0 * (b - r) / spread)
        .otherwise(240.0 + 60.0 * (r - g) / spread)
    )
    hue = F.when(sector < 0, sector + 360.0).otherwise(sector) / 2.0
    saturation = F.when(high == 0, 0.0).otherwise(255.0 * spread / high)
    return F.struct(hue.alias("h"), saturation.alias("s"), high.cast("double").alias("v"))


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return (g - F.greatest(r, b)) / 255.0


def recover_radiance(value: Column, veil: Column, transmission: Column, floor: float = 0.15) -> Column:
    """Scene value behind a veil: ``(I - A) / max(t, floor) + A`` clipped to [0, 1]."""
    depth = F.least(F.greatest(transmission, F.lit(floor)), F.lit(1.0))
    return F.least(F.greatest((value - veil) / depth + veil, F.lit(0.0)), F.lit(1.0))
