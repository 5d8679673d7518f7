"""Vision-sensor CAN payloads: bytes, bit slices and the decoded fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: message ids of the vision sensor
OBJECT_HEADER_ID = 0x738
OBJECT_FIRST_ID = 0x739
LANE_HEADER_ID = 0x766
LANE_IDS = ((0x766, 0x769), (0x76C, 0x77F))
LANE_NUMBERS = {0x766: -1, 0x768: 1, 0x76C: -2, 0x76E: 2}


def byte(data: Column, i: int) -> Column:
    """Byte ``i`` of a binary column as an int."""
    return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")


def bits(value: Column, low: int, high: int) -> Column:
    """Bits low..high-1, counted from the least significant one."""
    return F.shiftright(value, low).bitwiseAND((1 << (high - low)) - 1)


def word(high: Column, low: Column) -> Column:
    """A high part followed by one low byte."""
    return high * 256 + low


def signed(value: Column, width: int) -> Column:
    """Two's complement of ``width`` bits."""
    return F.when(value >= 1 << (width - 1), value - (1 << width)).otherwise(value)


def decode_object(a: Column, b: Column, c: Column) -> dict[str, Column]:
    """The three frames of one object."""
    x = [byte(a, i) for i in range(8)]
    return {
        "obj_id": x[0],
        "pos_x": word(bits(x[2], 0, 4), x[1]) * F.lit(0.0625),
        "pos_y": signed(word(bits(x[4], 0, 2), x[3]), 10) * F.lit(0.0625),
        "rel_vel_x": signed(word(bits(x[6], 0, 4), x[5]), 12) * F.lit(0.0625),
        "obj_type": bits(x[6], 4, 7),
        "status": bits(x[7], 0, 3),
        "braking": bits(x[7], 3, 4),
        "location": bits(x[4], 5, 7),
        "blinker": bits(x[4], 2, 5),
        "valid": bits(x[7], 6, 8),
        "length": byte(b, 0) * F.lit(0.05),
        "width": byte(b, 1) * F.lit(0.05),
        "age": byte(b, 2),
        "lane": bits(byte(b, 3), 0, 2),
        "acceleration_x": signed(byte(c, 4), 8) * F.lit(0.03),
    }


def decode_lane(a: Column, b: Column) -> dict[str, Column]:
    """The two frames of one lane."""
    x, y = [byte(a, i) for i in range(7)], [byte(b, i) for i in range(4)]
    middle = 0x7FFF
    return {
        "c0": signed(word(x[2], x[1]), 16) / F.lit(256.0),
        "c1": (word(y[1], y[0]) - middle) / F.lit(1024.0),
        "c2": (word(x[4], x[3]) - middle) / F.lit(1024000.0),
        "c3": (word(x[6], x[5]) - middle) / F.lit(float(1 << 28)),
        "lane_type": bits(x[0], 0, 4),
        "quality": bits(x[0], 4, 6),
        "model_degree": bits(x[0], 6, 8),
        "view_range_available": bits(y[3], 7, 8),
        "view_range": word(bits(y[3], 0, 7), y[2]) / F.lit(256.0),
    }


def decode_reference_point(a: Column) -> dict[str, Column]:
    x = [byte(a, i) for i in range(4)]
    return {
        "position": (word(x[1], x[0]) - 0x7FFF) / F.lit(256.0),
        "distance": word(bits(x[3], 0, 7), x[2]) / F.lit(256.0),
        "is_valid": bits(x[3], 7, 8),
    }


def lane_polynomial(x: Column, c0: Column, c1: Column, c2: Column, c3: Column) -> Column:
    """Lateral position (left positive) of a vision lane at distance ``x``."""
    return -(c0 + x * (c1 + x * (c2 + x * c3)))
