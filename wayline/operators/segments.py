"""Cutting ordered records into sweeps, groups and subsets, and smoothing series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.operators import blocks


def follow_marker(lines: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, marker: str, width: float) -> DataFrame:
    """Records that come right after a line containing ``marker``."""
    d = blocks.previous_row(lines, keys, order, [text], width, "_before")
    return d.where(F.col("_before")[text].contains(marker)).drop("_before")


def segment_by_start(
    messages: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    is_start: Column,
    width: float,
    name: str = "segment",
) -> DataFrame:
    """Number the segments: each start row opens a new one; 0 before the first."""
    flag = F.when(is_start, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return blocks.running_sum(messages, keys, order, {name: flag}, width)


def sweep_messages(
    messages: DataFrame,
    keys: Sequence[str],
    time: str,
    ident: str,
    is_start: Column,
    dropped: Column,
    kept: Column,
    width: float,
    lead_us: int = 66_000,
) -> DataFrame:
    """Radar messages with the time of their sweep (start message minus ``lead_us``).

    Start rows carry their time forward; control rows and unmeasured objects
    drop out afterwards, as do rows before the first start.
    """
    start = F.when(is_start, F.col(time) - lead_us)
    d = blocks.fill_last(messages, keys, [time, ident], {"sweep_us": start}, width)
    return d.where(F.col("sweep_us").isNotNull() & ~dropped & kept)


def wrap_segments(packets: DataFrame, keys: Sequence[str], order: Sequence[str], angle: str, width: float) -> DataFrame:
    """New sweep when the angle falls below the one before; ``sweep`` counts from 0."""
    d = blocks.previous_row(packets, keys, order, [angle], width, "_before")
    wrapped = F.coalesce(F.col(angle) < F.col("_before")[angle], F.lit(False))
    return segment_by_start(d, keys, order, wrapped, width, "sweep").drop("_before")


def group_under_header(
    frames: DataFrame, keys: Sequence[str], order: Sequence[str], is_header: Column, header_fields: Sequence[str], width: float
) -> DataFrame:
    """Attach the latest header's fields (``header`` struct) to every frame after it."""
    value = F.when(is_header, F.struct(*header_fields))
    return blocks.fill_last(frames, keys, order, {"header": value}, width).where("header IS NOT NULL")


def drop_incomplete(frames: DataFrame, group: Sequence[str], multiple: int) -> DataFrame:
    """Drop groups whose row count is no multiple of ``multiple``."""
    counts = frames.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") % multiple == 0)
    return frames.join(counts.drop("_n"), list(group), "left_semi")


def sequence_subset(
    items: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, first: int, last: int, step: int, add_last: bool = False
) -> DataFrame:
    """Items first, first+step, ... up to ``last`` (from 0; -1 is the end), optionally with the last item."""
    n = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = blocks.row_index(items, keys, order, width, "_rn").withColumn("_pos", F.col("_rn") - 1)
    d = d.join(n, list(keys))
    end = F.col("_n") - 1 if last < 0 else F.least(F.lit(last), F.col("_n") - 1)
    keep = (F.col("_pos") >= first) & (F.col("_pos") <= end) & ((F.col("_pos") - first) % step == 0)
    if add_last:
        keep = keep | (F.col("_pos") == F.col("_n") - 1)
    return d.where(keep).drop("_rn", "_n").withColumnRenamed("_pos", "pos")


def stride_sample(items: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, target: int) -> DataFrame:
    """About ``target`` rows per key: every (n // target)-th, at least every row."""
    n = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / target), F.lit(1))
    d = blocks.row_index(items, keys, order, width, "_rn").join(n, list(keys))
    return d.where((F.col("_rn") - 1) % step == 0).drop("_rn", "_n")


def drop_warm_up(frames: DataFrame, keys: Sequence[str], frame: str, width: float, history: int = 4) -> DataFrame:
    """Keep frames whose ``history`` predecessors in the list are the frames just before them.

    An unbroken stretch starts where the frame before is missing; a frame is
    kept when its stretch began at least ``history`` frames ago.
    """
    d = blocks.previous_row(frames, keys, [frame], [frame], width, "_before")
    broken = F.coalesce(F.col("_before")[frame] != F.col(frame) - 1, F.lit(True))
    d = blocks.fill_last(d, keys, [frame], {"_start": F.when(broken, F.col(frame))}, width)
    return d.where(F.col(frame) - F.col("_start") >= history).drop("_before", "_start")


def order_violations(items: DataFrame, keys: Sequence[str], position: str, index: str, width: float) -> DataFrame:
    """Rows whose index does not rise above the one before in the same key."""
    d = blocks.previous_row(items, keys, [position], [index], width, "_before")
    return d.withColumn("before", F.col("_before")[index]).where(F.col("before") >= F.col(index)).drop("_before")


def moving_average(
    series: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], width: float, window: int = 51, scale: int = 1_000_000
) -> DataFrame:
    """Centred mean over ``window`` rows; beyond the ends the edge value repeats. Adds ``<col>_avg`` columns.

    Rows go into blocks of consecutive rows that also hold half a window of both
    neighbours, so a row misses rows of its window only at the series' ends.
    Values are summed as whole ``1/scale`` units, which is exact in any order.
    """
    keys, order, half = list(keys), list(order), window // 2
    d = blocks.halo_blocks(series, keys, order, width, max(4096, window), half)
    d = d.withColumns({f"_u_{c}": F.round(F.col(c) * scale).cast("bigint") for c in cols})
    w = W.partitionBy(*keys, "block").orderBy("pos").rowsBetween(-half, half)
    w_before = W.partitionBy(*keys, "block").orderBy("pos").rowsBetween(-half, -1)
    w_after = W.partitionBy(*keys, "block").orderBy("pos").rowsBetween(1, half)
    d = d.withColumns({"_under": half - F.count("pos").over(w_before), "_over": half - F.count("pos").over(w_after)})
    sums = {
        f"{c}_avg": (
            F.sum(f"_u_{c}").over(w) + F.col("_under") * F.first(f"_u_{c}").over(w) + F.col("_over") * F.last(f"_u_{c}").over(w)
        )
        / F.lit(float(window * scale))
        for c in cols
    }
    return d.withColumns(sums).where("own").select(*series.columns, *sums)


def differences(series: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], width: float) -> DataFrame:
    """``d_<col>``: the row minus the one before; null on the first row."""
    d = blocks.previous_row(series, keys, order, cols, width, "_before")
    return d.withColumns({f"d_{c}": F.col(c) - F.col("_before")[c] for c in cols}).drop("_before")


def clip_derivative(
    series: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, width: float, limit: float = 0.1
) -> DataFrame:
    """Rebuild the series from its first value with every step held within ``limit`` (``<col>_held``)."""
    d = differences(series, keys, order, [col], width)
    step = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(f"d_{col}")))
    d = blocks.running_sum(d, keys, order, {f"{col}_held": F.coalesce(step, F.col(col))}, width)
    return d.drop(f"d_{col}")


def smooth_derivative(
    series: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, width: float, window: int = 51
) -> DataFrame:
    """Rebuild the series from its first value with its steps averaged over ``window`` rows (``<col>_smooth``)."""
    d = differences(series, keys, order, [col], width)
    steps = d.where(F.col(f"d_{col}").isNotNull())
    smooth = moving_average(steps, keys, order, [f"d_{col}"], width, window)
    first = d.where(F.col(f"d_{col}").isNull()).withColumn(f"d_{col}_avg", F.col(col))
    both = smooth.unionByName(first)
    both = blocks.running_sum(both, keys, order, {f"{col}_smooth": F.col(f"d_{col}_avg")}, width)
    return both.drop(f"d_{col}", f"d_{col}_avg")


def range_jumps(points: DataFrame, keys: Sequence[str], angle: str, tie: str, distance: str, width: float) -> DataFrame:
    """How far a return lies in front of its neighbours on the same laser (``jump``)."""
    here, zero = F.col(distance), F.lit(0.0)
    d = blocks.fill_around(
        points, keys, [angle, tie], width, last={"_before": here}, following={"_after": here}, include_current=False
    )
    jump = F.greatest(F.coalesce(F.col("_before") - here, zero), F.coalesce(F.col("_after") - here, zero), zero)
    return d.withColumn("jump", jump).drop("_before", "_after")
