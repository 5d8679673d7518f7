"""Trajectories: relative poses, summaries and matching of repeated drives."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.functions import geodesy, rotation
from wayline.operators import blocks, spatial
from wayline.session import cut_lineage

POSE = ["lat", "lon", "height", "rot_x", "rot_y", "azimuth"]


def with_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], suffix: str = "_0") -> DataFrame:
    """Attach the first row's ``cols`` of each key.

    One row per run is joined back; adaptive execution broadcasts it when its
    measured size allows and splits a hot run otherwise.
    """
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_f"))
    first = first.select(*keys, *[F.col("_f")[c].alias(c + suffix) for c in cols])
    return df.join(first, list(keys))


def _relative_rotation(base, suffix: str = "") -> dict[str, Column]:
    own = rotation.attitude(F.col("rot_x" + suffix), F.col("rot_y" + suffix), F.col("azimuth" + suffix))
    rel = rotation.mat_mul(base, rotation.transpose(own))
    return {f"r{i}{j}": rotation.as_column(rel[i][j]) for i in range(3) for j in range(3)}


def _base():
    return rotation.attitude(F.col("rot_x_0"), F.col("rot_y_0"), F.col("azimuth_0"))


def integrate_velocity(poses: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, dt: float | None = None) -> DataFrame:
    """Pose relative to the first one from summed velocity: ``px, py, pz, r00..r22``.

    ``dt`` is the step in seconds; by default the gap of the run's first two rows.
    """
    time = order[0]
    d = with_first(poses, keys, order, [*POSE, time])
    if dt is None:
        after_first = d.where(F.col(time) > F.col(f"{time}_0")).groupBy(*keys).agg(F.min(time).alias("_t1"))
        d = d.join(after_first, list(keys)).withColumn("_dt", (F.col("_t1") - F.col(f"{time}_0")) / F.lit(1e6)).drop("_t1")
    else:
        d = d.withColumn("_dt", F.lit(float(dt)))
    parts = {"_e": "v_east", "_n": "v_north", "_u": "v_up"}
    d = blocks.running_sum(d, keys, order, {o: F.col(c) * F.col("_dt") for o, c in parts.items()}, width)
    pos = rotation.mat_vec(_base(), [F.col("_e"), F.col("_n"), F.col("_u")])
    d = d.withColumns({**{n: rotation.as_column(p) for n, p in zip(("px", "py", "pz"), pos)}, **_relative_rotation(_base())})
    return d.drop("_e", "_n", "_u", "_dt", *[c + "_0" for c in [*POSE, time]])


def absolute_poses(poses: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pose relative to the run's first one from its coordinates: ``px, py, pz, r00..r22``."""
    d = with_first(poses, keys, order, POSE)
    ref = [F.col(c) for c in ("lat_0", "lon_0", "height_0")]
    enu = geodesy.wgs84_to_enu(F.col("lat"), F.col("lon"), F.col("height"), ref)
    pos = rotation.mat_vec(_base(), enu)
    d = d.withColumns({**{n: rotation.as_column(p) for n, p in zip(("px", "py", "pz"), pos)}, **_relative_rotation(_base())})
    return d.drop(*[c + "_0" for c in POSE])


def sideways(v_east: Column, v_north: Column) -> list[Column]:
    """Unit vector to the right of travel: velocity x up, normalised; null when standing."""
    size = F.sqrt(v_east * v_east + v_north * v_north)
    return [F.try_divide(v_north, size), F.try_divide(-v_east, size)]


def trace_summary(traces: DataFrame, keys: Sequence[str], order: Sequence[str], coords: Sequence[str], width: float) -> DataFrame:
    """Per run: bounding box, direction last - first (unit), path length, points."""
    step = blocks.previous_row(traces, keys, order, coords, width, "_before")
    d2 = None
    for c in coords:
        d = F.col(c) - F.col("_before")[c]
        d2 = d * d if d2 is None else d2 + d * d
    rank = F.struct(*order)
    agg = (
        step.withColumn("_step", F.sqrt(d2))
        .groupBy(*keys)
        .agg(
            *[F.min(c).alias(f"{c}_min") for c in coords],
            *[F.max(c).alias(f"{c}_max") for c in coords],
            *[(F.max_by(c, rank) - F.min_by(c, rank)).alias(f"_d_{c}") for c in coords],
            F.sum("_step").alias("path_length"),
            F.avg("_step").alias("mean_step"),
            F.count("*").alias("n_points"),
        )
    )
    size = F.sqrt(sum((F.col(f"_d_{c}") * F.col(f"_d_{c}") for c in coords[1:]), F.col(f"_d_{coords[0]}") * F.col(f"_d_{coords[0]}")))
    agg = agg.withColumn("_size", size)
    agg = agg.withColumns({f"dir_{c}": F.try_divide(F.col(f"_d_{c}"), F.col("_size")) for c in coords})
    return agg.drop("_size", *[f"_d_{c}" for c in coords])


def footage_length(logs: DataFrame, key: str, time: str) -> DataFrame:
    """Last minus first time per log and, under a null key, their total."""
    spans = logs.groupBy(key).agg((F.max(time) - F.min(time)).alias("length"))
    return spans.rollup(key).agg(F.sum("length").alias("length"))


def label_counts(runs: DataFrame, labels: str) -> DataFrame:
    """Runs per freeway label of a '+'-joined list."""
    return (
        runs.select(F.explode(F.split(labels, r"\+")).alias("label")).groupBy("label").agg(F.count("*").alias("n_runs"))
    )


def catalogue_filter(runs: DataFrame, name: str, labels: str, freeway: str, first: Column, last: Column) -> DataFrame:
    """Runs whose name holds a date (month-day-year) in the range and whose labels hold the freeway."""
    part = r"(\d+)-(\d+)-(\d+)"
    number = [F.regexp_extract(name, part, i).try_cast("int") for i in (1, 2, 3)]
    year = F.when(number[2] < 100, number[2] + 2000).otherwise(number[2])
    date = F.try_make_timestamp(year, number[0], number[1], F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
    return runs.withColumn("run_date", date).where(
        F.col("run_date").between(first, last) & F.array_contains(F.split(labels, r"\+"), freeway)
    )


def overlap_share(coords: Sequence[str], a: str, b: str) -> Column:
    """Twice the shared volume of two bounding boxes over the sum of their volumes."""
    shared = volume_a = volume_b = None
    for c in coords:
        lo_a, hi_a, lo_b, hi_b = (F.col(p + c + e) for p in (a, b) for e in ("_min", "_max"))
        side = F.greatest(F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b), F.lit(0.0))
        shared = side if shared is None else shared * side
        volume_a = (hi_a - lo_a) if volume_a is None else volume_a * (hi_a - lo_a)
        volume_b = (hi_b - lo_b) if volume_b is None else volume_b * (hi_b - lo_b)
    return F.try_divide(2 * shared, volume_a + volume_b)


#: runs that are compared as one group
GROUP = 64
#: boxes that settle where groups are cut, and how many of them a group has at least
CUT_FROM, CUT_LEAST = 65_536, 8


def _box_cuts(boxes: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Field and value of the cuts of a tree over boxes (box, lower and upper end by axis); node n goes on in 2 n + 1 and 2 n + 2.

    Cut is at the median of the field that differs most, measured by its axis' mean length.
    """
    fields, cuts, level = [], [], [np.arange(len(boxes))]
    for _ in range(depth):
        below = []
        for rows in level:
            own, field, cut = boxes[rows], 0, 0.0
            if len(own):
                length = np.repeat((own[:, 1::2] - own[:, ::2]).mean(axis=0), 2)
                field = int(np.argmax((own.max(axis=0) - own.min(axis=0)) / np.where(length > 0, length, 1.0)))
                cut = float(np.median(own[:, field]))
            beyond = own[:, field] > cut
            fields.append(field)
            cuts.append(cut)
            below += [rows[~beyond], rows[beyond]]
        level = below
    return fields, cuts


def _box_group(ends: Sequence[str], fields: Sequence[int], cuts: Sequence[float], depth: int) -> Column:
    """The group of a box by the cuts."""
    if not depth:
        return F.lit(0)

    def constants(values, kind):  # one text is quicker to hand over than thousands of literals
        return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")

    box, by, at = F.array(*ends), constants(fields, "int"), constants(cuts, "double")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda n, _: 2 * n + 1 + F.when(F.get(box, F.get(by, n)) > F.get(at, n), 1).otherwise(0)
    )


def _volume(coords: Sequence[str], prefix: str = "") -> Column:
    volume = None
    for c in coords:
        side = F.col(prefix + c + "_max") - F.col(prefix + c + "_min")
        volume = side if volume is None else volume * side
    return volume


def _greatest_share(coords: Sequence[str]) -> Column:
    """Bound on the share of box ``a_`` with any box of a group: of its extent (``g_``) and least and greatest volume."""
    shared = None
    for c in coords:
        side = F.greatest(F.least("a_" + c + "_max", "g_" + c + "_max") - F.greatest("a_" + c + "_min", "g_" + c + "_min"), F.lit(0.0))
        shared = side if shared is None else shared * side
    own = _volume(coords, "a_")
    # the shared volume is at most either box's, so the share grows with the other's volume up to ``own`` and falls beyond
    shared = F.least(shared, own, "g_most")
    return F.try_divide(2 * shared, own + F.greatest(F.col("g_least"), shared)) * (1 + 1e-9)


def likely_best(a: DataFrame, b: DataFrame, run: str, coords: Sequence[str], min_share: float, same_way: bool = False) -> DataFrame:
    """Pairs of runs of the two summaries with all that can be the best of a run of ``a``: columns ``a_``, ``b_``, share.

    The share is at least ``min_share``, with ``same_way`` above it and only for
    runs in the same direction. The best is the one of largest share, then
    smallest run. A run first meets the runs of ``b`` in its own group of alike boxes, then
    those of the groups in which, by their extents, a share as large as the
    best there is possible; lesser pairs are left out before anything is
    sorted. Of equal boxes of ``b`` the two smallest runs are kept, as one may be
    the run itself. Boxes with ends that are not finite have no pair.
    """
    ends = [c + e for c in coords for e in ("_min", "_max")]
    ways = [f"dir_{c}" for c in coords]
    a = cut_lineage(spatial.usable(a.select(run, *ends, *ways), ends))
    alike = W.partitionBy(*ends, *(ways if same_way else ())).orderBy(run)
    b = spatial.usable(b, ends).where(F.col(run).isNotNull()).withColumn("_nth", F.row_number().over(alike)).where("_nth <= 2").drop("_nth")
    b = cut_lineage(b)
    some = b.orderBy(F.xxhash64(run)).limit(CUT_FROM).select(*ends).toPandas().to_numpy(float)
    depth = max(0, math.ceil(math.log2(max(b.count(), 1) / GROUP)))
    depth = min(depth, int(math.log2(max(len(some) // CUT_LEAST, 1))))
    group = _box_group(ends, *_box_cuts(some, depth), depth)
    a, b = (d.select(*[F.col(c).alias(p + c) for c in d.columns], group.alias("_group")) for p, d in (("a_", a), ("b_", b)))

    # pairs take far longer than the few bytes of their runs suggest, so tasks are not merged by size
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(asked: DataFrame, least: Column) -> DataFrame:
        # the runs of b wait in memory, so the pairs of a group are formed without a sort
        d = asked.repartition(tasks, "_group").join(b.repartition(tasks, "_group").hint("shuffle_hash"), "_group").where(F.col("a_" + run) != F.col("b_" + run))
        d = d.withColumn("share", overlap_share(coords, "a_", "b_")).where(F.col("share") >= least)
        return d.where((F.col("share") > min_share) & same_direction(coords)) if same_way else d

    extents = b.groupBy("_group").agg(
        *[f("b_" + c + e).alias("g_" + c + e) for c in coords for f, e in ((F.min, "_min"), (F.max, "_max"))],
        F.min(_volume(coords, "b_")).alias("g_least"), F.max(_volume(coords, "b_")).alias("g_most"),
    )
    near = pairs(a, F.lit(min_share)).groupBy("a_" + run).agg(F.max("share").alias("_least"))
    asked = a.drop("_group").join(near, "a_" + run, "left").withColumn("_least", F.coalesce("_least", F.lit(min_share))).repartition(tasks, "a_" + run)
    # one row a group, of which there are at most CUT_FROM / CUT_LEAST
    asked = asked.join(F.broadcast(extents), _greatest_share(coords) >= F.col("_least"))
    return pairs(asked.drop(*[c for c in extents.columns if c != "_group"]), F.col("_least")).drop("_group", "_least")


def same_direction(coords: Sequence[str]) -> Column:
    """At most 90 degrees between the two directions."""
    dot = None
    for c in coords:
        term = F.col(f"a_dir_{c}") * F.col(f"b_dir_{c}")
        dot = term if dot is None else dot + term
    return dot >= 0


def best_overlaps(summaries: DataFrame, run: str, coords: Sequence[str], min_share: float = 0.25) -> DataFrame:
    """Run pairs (run1 < run2): each run with its best-overlapping other run, if that one goes the same way; written when this is called."""
    summaries = cut_lineage(summaries)
    pairs = likely_best(summaries, summaries, run, coords, min_share).withColumn("_same", same_direction(coords))
    # largest share, then smallest run; run ids may be of any type that has an order
    best = pairs.groupBy(F.col("a_" + run).alias("_a")).agg(F.min(F.struct((-F.col("share")).alias("_less"), F.col("b_" + run).alias("_b"), "_same")).alias("_m"))
    best = best.where("_m._same").select(
        F.least("_a", "_m._b").alias("run1"), F.greatest("_a", "_m._b").alias("run2"), (-F.col("_m._less")).alias("share")
    )
    return cut_lineage(best.distinct())


def propagate_labels(
    summaries: DataFrame, labels: DataFrame, run: str, coords: Sequence[str], label: str, min_share: float = 0.25
) -> DataFrame:
    """Label of the best-overlapping labelled run in the same direction for every unlabelled run, else ``none``."""
    summaries = cut_lineage(summaries)
    open_ = summaries.join(labels, run, "left_anti")
    known = summaries.join(labels, run)
    pairs = likely_best(open_, known, run, coords, min_share, same_way=True)
    best = pairs.groupBy(F.col("a_" + run).alias(run)).agg(
        F.min_by("b_" + label, F.struct(-F.col("share"), F.col("b_" + run))).alias(label)
    )
    return open_.select(run).join(best, run, "left").withColumn(label, F.coalesce(label, F.lit("none")))


def apply_alignment(
    points: DataFrame, chunks: DataFrame, keys: Sequence[str], frame: str, coords: Sequence[str], width: float
) -> DataFrame:
    """Turn and shift each chunk of frames about its own mean.

    ``chunks`` holds start and end frame (end exclusive), r00..r22 and tx, ty, tz.
    Frames outside every chunk stay as they are.
    """
    from wayline.operators import timejoin

    keys = list(keys)
    take = ["start", "end", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"]
    c = chunks.select(*keys, F.col("start").alias("_at"), *take)
    d = timejoin.asof_backward(points, c, keys, frame, "_at", take, width, how="left")
    inside = F.col(frame) < F.col("end")
    d = d.withColumn("start", F.when(inside, F.col("start")))
    means = d.where("start IS NOT NULL").groupBy(*keys, "start").agg(*[F.avg(x).alias(f"_m_{x}") for x in coords])
    d = d.join(means, [*keys, "start"], "left")
    m = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    moved = rotation.about_point(m, [F.col(f"_m_{x}") for x in coords], [F.col(t) for t in ("tx", "ty", "tz")], [F.col(x) for x in coords])
    out = d.withColumns({f"_new_{x}": F.when(F.col("start").isNotNull(), v).otherwise(F.col(x)) for x, v in zip(coords, moved)})
    return out.select(*[F.col(f"_new_{x}").alias(x) if x in coords else F.col(x) for x in points.columns])


def alignment_score(source: DataFrame, target: DataFrame, keys: Sequence[str], coords: Sequence[str], target_id: str, tolerance: float = 2.0) -> DataFrame:
    """Mean and median distance of nearest centres per key, in space and with heights set to 0."""
    keys = list(keys)
    out = None
    for tag, flat in (("", False), ("_flat", True)):
        def level(df):
            return df.withColumn(coords[2], F.lit(0.0)) if flat else df

        near = spatial.nearest_within(level(source), level(target), keys, coords, tolerance, target_id)
        mean = near.groupBy(*keys).agg(F.avg("dist").alias(f"mean{tag}"), F.count("*").alias(f"n{tag}"))
        median = blocks.grouped_median(near, keys, ["dist"], tolerance / 16).withColumnRenamed("dist", f"median{tag}")
        part = mean.join(median, keys)
        out = part if out is None else out.join(part, keys, "full")
    return out
