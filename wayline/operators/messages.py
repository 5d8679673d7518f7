"""Objects and lanes of the vision sensor, assembled from the CAN frames that follow their header frames.

``frames`` hold the keys, a time, an order among equal times, ``can_id`` and
``data`` (8 bytes). A header opens a group; its frames count until the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions import can
from wayline.operators import blocks, segments


def object_members(frames: DataFrame, announced: Column) -> Column:
    """Whether a frame is one of the objects its header announced: three ids for each."""
    first = can.OBJECT_FIRST_ID
    return (announced > 0) & F.col("can_id").between(first, first + 3 * announced - 1)


def _grouped(frames: DataFrame, keys: Sequence[str], time: str, order: str, width: float, header: int) -> DataFrame:
    """Frames behind a header with its time, order and first byte."""
    is_header = F.col("can_id") == header
    d = frames.withColumn("_announced", F.when(is_header, can.byte(F.col("data"), 0)))
    d = segments.group_under_header(d, keys, [time, order], is_header, [time, order, "_announced"], width)
    head = {"header_time": F.col("header")[time], "_header": F.col("header")[order], "_announced": F.col("header._announced")}
    return d.withColumns(head).drop("header")


def _numbered(members: DataFrame, group: Sequence[str], order: Sequence[str], width: float, size: int) -> DataFrame:
    """Members of whole groups only, with ``_unit`` and the part of the unit each one is; ``size`` frames are a unit."""
    d = blocks.running_sum(members, group, order, {"_rn": F.lit(1).cast("bigint")}, width, totals={"_rn": "_members"})
    d = d.where(F.col("_members") % size == 0)
    return d.withColumns({"_unit": F.floor((F.col("_rn") - 1) / size), "_part": (F.col("_rn") - 1) % size})


def _units(numbered: DataFrame, group: Sequence[str], size: int, fields: Sequence[str]) -> DataFrame:
    """One row per unit, the fields of its parts side by side as ``<field>_<part>``."""
    parts = [F.max(F.when(F.col("_part") == p, F.col(f))).alias(f"{f}_{p}") for f in fields for p in range(size)]
    return numbered.groupBy(*group, "_unit").agg(*parts)


def can_objects(frames: DataFrame, keys: Sequence[str], time: str, order: str, width: float) -> DataFrame:
    """One row per object of three frames: keys, ``header_time``, ``unit`` (from 0) and the decoded fields.

    The frames of a group are those whose id lies in the range of the count its
    header announced, in order of arrival. Groups whose number of frames is no
    multiple of three drop out as a whole, as do frames before the first header.
    """
    group = [*keys, "header_time", "_header"]
    d = _grouped(frames, keys, time, order, width, can.OBJECT_HEADER_ID)
    d = d.where(object_members(d, F.col("_announced"))).select(*group, time, order, "data")
    units = _units(_numbered(d, group, [time, order], width, 3), group, 3, ["data"])
    fields = can.decode_object(*[F.col(f"data_{p}") for p in range(3)])
    return units.select(*keys, "header_time", F.col("_unit").alias("unit"), *[c.alias(n) for n, c in fields.items()])


def can_lanes(frames: DataFrame, keys: Sequence[str], time: str, order: str, width: float, id_width: float = 4) -> DataFrame:
    """One row per lane of two frames: keys, ``header_time``, ``lane_id`` and the decoded fields.

    The header frame is the first frame of the first lane. Frames of a group are
    taken by id. Groups with an odd number of frames, or with a pair whose ids do
    not follow each other, drop out as a whole. ``lane_id`` counts from the car:
    negative to the left; ids without a known lane give null.
    """
    group = [*keys, "header_time", "_header"]
    d = _grouped(frames, keys, time, order, width, can.LANE_IDS[0][0])
    inside = [F.col("can_id").between(low, high) for low, high in can.LANE_IDS]
    d = d.where(inside[0] | inside[1]).select(*group, time, order, "can_id", "data")
    units = _units(_numbered(d, group, ["can_id", time, order], id_width, 2), group, 2, ["can_id", "data"])
    paired = F.col("can_id_1") - F.col("can_id_0") == 1
    broken = units.where(~paired).select(*group).distinct()
    lane = F.create_map(*[F.lit(x) for pair in can.LANE_NUMBERS.items() for x in pair])
    fields = can.decode_lane(F.col("data_0"), F.col("data_1"))
    return units.join(broken, group, "left_anti").select(
        *keys, "header_time", lane[F.col("can_id_0")].alias("lane_id"), F.col("_unit").alias("unit"), *[c.alias(n) for n, c in fields.items()]
    )
