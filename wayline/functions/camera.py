"""Pinhole cameras, sensor frames and colours as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions.rotation import Matrix, Vector, as_column, dot, mat_vec


def shift_then_rotate(p: Vector, shift: Vector, turn: Matrix) -> list[Column]:
    """Radar or vision sensor coordinates to the vehicle frame."""
    return mat_vec(turn, [a + b for a, b in zip(p, shift)])


def with_pixels(df: DataFrame, p: Vector, focal: Vector, centre: Vector, distort: Sequence[float]) -> DataFrame:
    """Add pixels u, v of camera-frame points under radial (k1, k2, k3) and tangential (p1, p2) distortion.

    Points in or behind the image plane drop out; cam_x, cam_y, cam_z are kept.
    The one-element explode keeps a later filter on u or v above the projection,
    where it would otherwise be pushed down with the whole formula written out.
    """
    k1, k2, p1, p2, k3 = distort
    cam = ["cam_x", "cam_y", "cam_z"]
    d = df.withColumns({n: as_column(c) for n, c in zip(cam, p)}).where("cam_z > 0")
    d = d.withColumns({"_x": F.col("cam_x") / F.col("cam_z"), "_y": F.col("cam_y") / F.col("cam_z")})
    x, y, r2 = F.col("_x"), F.col("_y"), F.col("_r2")
    d = d.withColumn("_r2", x * x + y * y).withColumn("_radial", 1 + r2 * (k1 + r2 * (k2 + r2 * k3)))
    u = x * F.col("_radial") + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    v = y * F.col("_radial") + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    pixel = F.struct((focal[0] * u + centre[0]).alias("u"), (focal[1] * v + centre[1]).alias("v"))
    d = d.withColumn("_pixel", F.explode(F.array(pixel)))
    return d.withColumns({"u": F.col("_pixel.u"), "v": F.col("_pixel.v")}).drop("_x", "_y", "_r2", "_radial", "_pixel")


def visible(width: int | Column, height: int | Column, margin: int = 2, min_dist2: float = 3.0) -> Column:
    """Pixel of :func:`with_pixels`, rounded to a whole one, inside the image by ``margin`` and point not too near."""
    inside = [(F.rint(c) > margin) & (F.rint(c) < size - 1 - margin) for c, size in (("u", width), ("v", height))]
    p = [F.col(c) for c in ("cam_x", "cam_y", "cam_z")]
    return inside[0] & inside[1] & (as_column(dot(p, p)) > min_dist2)


def pixel_ray(u: Column, v: Column, focal: Vector, centre: Vector) -> list[Column]:
    """Direction of a pixel in the camera frame, depth one."""
    return [(u - centre[0]) / focal[0], (v - centre[1]) / focal[1], F.lit(1.0)]


def ray_on_plane(origin: Vector, ray: Vector, normal: Vector, point: Vector) -> list[Column]:
    """Where a ray meets a plane; null when they are parallel."""
    along = F.try_divide(as_column(dot([a - b for a, b in zip(point, origin)], normal)), as_column(dot(ray, normal)))
    return [o + along * r for o, r in zip(origin, ray)]


def flat_road_point(ray: Vector, camera_height: float) -> list[Column]:
    """Camera-frame point of a ray on a flat road below the camera."""
    depth = F.try_divide(F.lit(camera_height), as_column(ray[1]))
    return [ray[0] * depth, F.lit(camera_height), ray[2] * depth]


def _hue_channel(offset: float, hue: Column) -> Column:
    """How far one channel of a fully saturated hue is turned down, in [0, 1]."""
    h = F.pmod(hue * 6 + offset, F.lit(6.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(h, 4 - h)))


def heat_ramp(value: Column, low: float, high: float) -> list[Column]:
    """Hue 0 to 0.4 over the range, fully saturated, as r, g, b in 0..255."""
    hue = value / (high - low) * 0.4
    return [255 * (1 - _hue_channel(k, hue)) for k in (5.0, 3.0, 1.0)]


def light_ramp(value: Column, low: float, high: float) -> list[Column]:
    """Hue falls from 1 to 0 and lightness rises from 0 to one half over the range."""
    share = value / (high - low)
    return [255 * share * (1 - _hue_channel(k, 1 - share)) for k in (5.0, 3.0, 1.0)]
