"""Keys in image and file names, fixed-point lane codes and local map poses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_IMAGE = r"^(.*)_(\d+)(\.[^.]*)$"


def image_prefix(name: Column) -> Column:
    return F.regexp_extract(name, _IMAGE, 1)


def image_number(name: Column) -> Column:
    return F.regexp_extract(name, _IMAGE, 2).try_cast("bigint")


def next_image(name: Column, step: int = 1) -> Column:
    """The name ``step`` images on, with the same number of digits (more if needed)."""
    digits = F.regexp_extract(name, _IMAGE, 2)
    number = (digits.try_cast("bigint") + step).cast("string")
    padded = F.lpad(number, F.greatest(F.length(digits), F.length(number)), F.lit("0"))
    return F.concat(image_prefix(name), F.lit("_"), padded, F.regexp_extract(name, _IMAGE, 3))


def last_path_parts(path: Column, count: int) -> Column:
    return F.substring_index(path, "/", -count)


def lane_code(value: Column) -> Column:
    """Fixed-point code of a lateral lane position."""
    return F.floor((value + 327.68) / 0.01)


def centre_line(left: Column, right: Column) -> Column:
    """Middle of two arrays of positions."""
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def map_yaw(heading: Column, zero_heading: float) -> Column:
    """Compass heading to map yaw in degrees, wrapped to (-180, 180]."""
    yaw = 180 + zero_heading - heading
    return F.when(yaw > 180, yaw - 360).when(yaw < -180, yaw + 360).otherwise(yaw)


def local_map_pose(x: Column, y: Column, yaw_deg: Column, zero_heading: float, origin: tuple[float, float], antenna: float) -> list[Column]:
    """Rotate to the local zero, shift to its origin and move from antenna to rear axle."""
    turn = F.radians(F.lit(zero_heading))
    # (x, -y) turned by the zero heading, seen from the other side
    rx = x * F.cos(turn) + y * F.sin(turn)
    ry = x * F.sin(turn) - y * F.cos(turn)
    yaw = F.radians(yaw_deg)
    return [origin[0] - rx - antenna * F.cos(yaw), origin[1] - ry - antenna * F.sin(yaw)]
