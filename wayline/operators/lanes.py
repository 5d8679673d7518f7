"""Lane curves: candidates, assignment, nearest lanes, ego-lane traces and labels ahead."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from wayline.functions import rotation
from wayline.operators import banded, blocks, pyramid, segments, spatial, timejoin
from wayline.session import cut_lineage

XYZ = ["x", "y", "z"]


def lane_candidates(left: DataFrame, right: DataFrame, keys: Sequence[str], n_left: int, n_right: int, coords: Sequence[str] = XYZ) -> DataFrame:
    """Lane k = right + (right - left) k for k from -n_left to n_right - 1; ``lane_no`` counts from 0."""
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in coords])
    d = left.join(r, list(keys)).withColumn("_k", F.explode(F.sequence(F.lit(-n_left), F.lit(n_right - 1))))
    new = [(F.col(f"_r_{c}") + (F.col(f"_r_{c}") - F.col(c)) * F.col("_k")).alias(c) for c in coords]
    return d.select(*keys, (F.col("_k") + n_left).alias("lane_no"), *new)


# fixed values: how far a marking may lie from lane 0, 1, ... to belong to it, in metres
LANE_LIMITS = (0.5, 1.2, 2.2, 3.2, 4.2)


def assign_to_lanes(
    points: DataFrame, candidates: DataFrame, keys: Sequence[str], ident: str, time: str, seq: str, width: float, n_segments: int = 200
) -> DataFrame:
    """Points with the number of the nearest candidate lane in their part of the drive, if near enough.

    The drive is cut into ``n_segments`` equal pieces of the lane curve; a point
    belongs to the first piece that ends at or after its time.
    """
    keys = list(keys)
    total = candidates.groupBy(*keys).agg(F.max(seq).alias("_last"))
    c = candidates.join(total, keys).withColumn("_segment", F.floor(F.col(seq) * n_segments / (F.col("_last") + 1)))
    ends = c.groupBy(*keys, "_segment").agg(F.max(time).alias("_end"))
    p = timejoin.asof_forward(points, ends, keys, time, "_end", ["_segment"], width, tie="_segment", allow_equal=True)
    target = c.select(*keys, "_segment", (F.col("lane_no").cast("bigint") * (1 << 40) + F.col(seq)).alias("_lane"), *XYZ)
    near = spatial.nearest_within(p, target, [*keys, "_segment"], XYZ, LANE_LIMITS[-1], "_lane", levels=(16, 4, 1))
    lane = F.floor(F.col("_lane") / (1 << 40))
    limit = F.element_at(F.array(*[F.lit(v) for v in LANE_LIMITS]), F.least(lane + 1, F.lit(len(LANE_LIMITS))).cast("int"))
    near = near.withColumn("lane_no", lane).where((F.col("lane_no") < len(LANE_LIMITS)) & (F.col("dist") < limit))
    return near.drop("_segment", "_lane")


def nearest_sides(poses: DataFrame, lanes: DataFrame, keys: Sequence[str], pose: str, lane_no: str, point: str, first: float = 8.0) -> DataFrame:
    """Nearest lane point left (y >= 0) and right of each pose, in its own frame, at any distance.

    ``poses`` holds px, py, pz and r00..r22. One nearest search per lane, from
    ``first`` on, then the better lane per side: ``side, lane_no, point, dist``.
    """
    keys = list(keys)
    numbers = lanes.select(*keys, lane_no).distinct()
    asked = poses.join(numbers, keys).withColumns({c: F.col("p" + c) for c in XYZ})
    near = spatial.nearest(asked, lanes, [*keys, lane_no], XYZ, first, point, levels=(8, 1))
    at = lanes.select(*keys, lane_no, point, *[F.col(c).alias(f"_l_{c}") for c in XYZ])
    near = near.join(at, [*keys, lane_no, point])
    m = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    y_own = rotation.rigid_inverse(m, [F.col("p" + c) for c in XYZ], [F.col(f"_l_{c}") for c in XYZ])[1]
    near = near.withColumn("side", F.when(y_own >= 0, "left").otherwise("right"))
    best = near.groupBy(*keys, pose, "side").agg(F.min(F.struct("dist", lane_no, point)).alias("_b"))
    return best.select(*keys, pose, "side", *[F.col("_b")[c].alias(c) for c in (lane_no, point, "dist")])


def snap_to_planes(points: DataFrame, planes: DataFrame, keys: Sequence[str], plane: str, first: float = 8.0, levels=(8, 1)) -> DataFrame:
    """Move points onto the plane (nx..nz through px..pz) whose point is nearest, at any distance; the search starts at ``first``."""
    at = planes.select(*keys, plane, *[F.col("p" + c).alias(c) for c in XYZ])
    near = spatial.nearest(points, at, keys, XYZ, first, plane, levels=levels)
    d = near.join(planes.select(*keys, plane, *["n" + c for c in XYZ], *["p" + c for c in XYZ]), [*keys, plane])
    off = rotation.dot([F.col(c) - F.col("p" + c) for c in XYZ], [F.col("n" + c) for c in XYZ])
    d = d.withColumn("offset", off)
    d = d.withColumns({f"{c}_flat": F.col(c) - F.col("offset") * F.col("n" + c) for c in XYZ})
    return d.drop("dist", *["n" + c for c in XYZ], *["p" + c for c in XYZ])


def section_in_view(
    frames: DataFrame, poses: DataFrame, lanes: DataFrame, keys: Sequence[str], frame: str, time: str, seq: str,
    half_us: int = 5_000_000, reach: float = 100.0,
) -> DataFrame:
    """Lane points of each frame between the ones nearest to the first and last pose within ``half_us``.

    Only points within ``reach`` of the frame's own pose can mark the ends.
    ``frames`` and ``poses`` hold time and x, y, z.
    """
    keys = list(keys)
    f = frames.select(*keys, frame, F.col(time).alias("_t"), *[F.col(c).alias("f_" + c) for c in XYZ])
    window = timejoin.window_join(f, poses.select(*keys, F.col(time).alias("_pt"), *XYZ), keys, "_t", "_pt", half_us - 1, half_us - 1)
    ends = window.groupBy(*keys, frame).agg(
        *[F.first("f_" + c).alias(c) for c in XYZ],
        F.min_by(F.struct(*XYZ), "_pt").alias("_near"),
        F.max_by(F.struct(*XYZ), "_pt").alias("_far"),
    )
    close = spatial.radius_join(ends, lanes, keys, XYZ, reach, prefix="c_")

    def d2(end):
        return spatial.dist2([F.col(c) for c in XYZ], [F.col(end)[c] for c in XYZ])

    picked = close.groupBy(*keys, F.col("c_" + frame).alias(frame), "lane_no").agg(
        F.min(F.struct(d2("c__near").alias("d"), F.col(seq).alias("s"))).alias("_n"),
        F.min(F.struct(d2("c__far").alias("d"), F.col(seq).alias("s"))).alias("_f"),
    )
    ranges = picked.select(*keys, frame, "lane_no", F.col("_n.s").alias("seq_from"), F.col("_f.s").alias("seq_to"))
    return ranges.where("seq_from <= seq_to")


def points_of_sections(
    sections: DataFrame, lanes: DataFrame, keys: Sequence[str], frame: str, seq: str, piece: int = 256, width: float = 65536
) -> DataFrame:
    """All lane points of the sections, joined on pieces of ``piece`` consecutive points of the lane.

    Pieces go by the points' numbers in their lane, so a section meets no more
    pieces than its points fill, however far apart their ``seq`` lie.
    """
    k = [*keys, "lane_no"]
    l = blocks.row_index(lanes, k, [seq], width, "_no")
    no = l.select(*k, F.col(seq).alias("_at"), "_no")
    s = timejoin.asof_forward(sections, no.withColumnRenamed("_no", "_first"), k, "seq_from", "_at", ["_first"], width, tie="_first", allow_equal=True)
    s = timejoin.asof_backward(s, no.withColumnRenamed("_no", "_last"), k, "seq_to", "_at", ["_last"], width, tie="_last")
    s = s.where("_first <= _last").withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_first") / piece), F.floor(F.col("_last") / piece))))
    l = l.withColumn("_piece", F.floor(F.col("_no") / piece))
    d = s.join(l, [*k, "_piece"]).where(F.col("_no").between(F.col("_first"), F.col("_last")))
    return d.drop("_piece", "_no", "_first", "_last")


def across_hits(
    poses: DataFrame, points: DataFrame, keys: Sequence[str], pose: str, ident: str, along: float = 30.0, limit: float = 0.5, cell: float = 1.0
) -> DataFrame:
    """Per pose and side the point nearest to the pose's sideways line (sx, sy, sz), if within ``limit``.

    Only points within ``along`` of the pose in x count. The occupied cells are
    tested against the line first, then only the points of the cells it crosses.
    """
    keys = list(keys)
    pts = points.withColumns({"_cx": F.floor(F.col("x") / F.lit(cell)), "_cy": F.floor(F.col("y") / F.lit(cell))})
    cells = pts.select(*keys, "side", "_cx", "_cy").distinct()
    p = poses.select(*keys, pose, *[F.col(c).alias("p" + c) for c in XYZ], "sx", "sy", "sz")
    # poses and cells meet by blocks as wide as the reach: a row a column of cells would copy a pose many times
    wide = max(1, math.ceil(2 * along / cell))
    p = p.withColumns({"_lo": F.floor((F.col("px") - along) / F.lit(cell)), "_hi": F.floor((F.col("px") + along) / F.lit(cell))})
    p = p.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("_lo") / wide), F.floor(F.col("_hi") / wide))))
    flat = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    mid_x, mid_y = (F.col("_cx") + 0.5) * cell - F.col("px"), (F.col("_cy") + 0.5) * cell - F.col("py")
    off = F.abs(mid_x * F.col("sy") - mid_y * F.col("sx"))
    met = p.join(cells.withColumn("_bx", F.floor(F.col("_cx") / wide)), [*keys, "_bx"]).where(F.col("_cx").between(F.col("_lo"), F.col("_hi")))
    crossed = met.where(off <= flat * (limit + cell * 0.7072)).drop("_bx", "_lo", "_hi")
    near = crossed.join(pts, [*keys, "side", "_cx", "_cy"])
    rel = [F.col(c) - F.col("p" + c) for c in XYZ]
    dist = rotation.norm(rotation.cross(rel, [F.col("sx"), F.col("sy"), F.col("sz")]))
    near = near.where(F.abs(rel[0]) < along).withColumn("_d", dist).where(F.col("_d") <= limit)
    best = near.groupBy(*keys, pose, "side").agg(
        F.min(F.struct("_d", ident, *[r.alias(f"d{c}") for r, c in zip(rel, XYZ)])).alias("_b")
    )
    return best.select(*keys, pose, "side", *[F.col("_b")[n].alias(n) for n in (ident, "dx", "dy", "dz")])


def ego_lane_trace(
    poses: DataFrame, points: DataFrame, keys: Sequence[str], pose: str, order: Sequence[str], ident: str, width: float,
    along: float = 30.0, limit: float = 0.5, window: int = 51,
) -> DataFrame:
    """Left and right lane curve beside the trajectory.

    Offsets to the lane points straight beside each pose are filled linearly
    over poses without one (the nearest value beyond the ends), averaged over
    ``window`` poses and added back. Sides without any hit drop out.
    """
    keys = list(keys)
    hits = cut_lineage(across_hits(poses, points, keys, pose, ident, along, limit))  # one row per pose and side
    sides = hits.select(*keys, "side").distinct()
    d = poses.select(*keys, pose, *order, *XYZ).join(sides, keys).join(
        hits.select(*keys, pose, "side", "dx", "dy", "dz"), [*keys, pose, "side"], "left"
    )
    k = [*keys, "side"]
    d = blocks.row_index(d, k, order, width, "_no")
    known = F.when(F.col("dx").isNotNull(), F.struct("_no", "dx", "dy", "dz"))
    d = blocks.fill_around(d, k, order, width, last={"_p": known}, following={"_n": known})
    gap = F.col("_n._no") - F.col("_p._no")
    f = F.when(gap > 0, (F.col("_no") - F.col("_p._no")) / gap).otherwise(F.lit(0.0))
    filled = {
        c: F.when(F.col("_p").isNull(), F.col("_n")[c]).when(F.col("_n").isNull(), F.col("_p")[c]).otherwise(
            (1 - f) * F.col("_p")[c] + f * F.col("_n")[c]
        )
        for c in ("dx", "dy", "dz")
    }
    d = d.withColumns(filled).drop("_p", "_n", "_no")
    d = segments.moving_average(d, k, order, ["dx", "dy", "dz"], width, window)
    return d.select(*k, pose, *[(F.col(c) + F.col(f"d{c}_avg")).alias(f"lane_{c}") for c in XYZ])


def far_lane_points(
    frames: DataFrame, points: DataFrame, keys: Sequence[str], frame: str, point_frame: str, ahead: int, inner: float = 165.0, outer: float = 175.0
) -> DataFrame:
    """Median of each side's points in a distance shell, per frame; frames that lack a side drop out.

    Points count when their frame lies after this one, by less than ``ahead``.
    """
    from wayline.operators.filters import distance_shell

    keys = list(keys)
    f = frames.select(*keys, frame, *[F.col(c).alias("f" + c) for c in XYZ])
    near = timejoin.window_join(f, points, keys, frame, point_frame, -1, ahead - 1)
    dist = F.sqrt(spatial.dist2([F.col(c) for c in XYZ], [F.col("f" + c) for c in XYZ]))
    shell = distance_shell(near.withColumn("_d", dist), "_d", inner, outer)
    med = blocks.grouped_median(shell, [*keys, frame, "side"], XYZ, outer / 16)
    wide = med.groupBy(*keys, frame).agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("left", "right") for c in XYZ]
    )
    return wide.where("left_x IS NOT NULL AND right_x IS NOT NULL")


def offset_by_median(lanes: DataFrame, measured: DataFrame, keys: Sequence[str], lane_no: str, ident: str, limit: float = 0.25) -> DataFrame:
    """Shift each lane by the median offset to the measured points nearest to it; lanes without any stay."""
    keys = list(keys)
    near = spatial.nearest_within(lanes, measured, keys, XYZ, limit, ident, place="_m_")
    offs = near.select(*keys, lane_no, *[(F.col(f"_m_{c}") - F.col(c)).alias(f"d{c}") for c in XYZ])
    med = blocks.grouped_median(offs, [*keys, lane_no], [f"d{c}" for c in XYZ], limit / 16)
    d = lanes.join(med, [*keys, lane_no], "left")
    return d.withColumns({c: F.col(c) + F.coalesce(F.col(f"d{c}"), F.lit(0.0)) for c in XYZ}).drop("dx", "dy", "dz")


def frames_ahead(
    poses: DataFrame, keys: Sequence[str], frame: str, step: str, width: float, marks: Sequence[float] = tuple(range(10, 90, 10)), offset: float = 2.0
) -> DataFrame:
    """For every frame the first later frame at each distance mark (plus ``offset``): frame, mark, ahead.

    ``step`` is the distance covered in a frame. The search is an as-of join on
    the running distance. Frames that do not reach all marks drop out.
    """
    keys = list(keys)
    run = blocks.running_sum(poses.select(*keys, frame, step), keys, [frame], {"_cum": F.col(step)}, width).drop(step)
    asked = run.select(*keys, frame, F.col("_cum").alias("_from"), F.explode(F.array(*[F.lit(float(m)) for m in marks])).alias("mark"))
    asked = asked.withColumn("_want", F.col("_from") + F.col("mark") + offset)
    reached = run.select(*keys, F.col("_cum").alias("_at"), F.col(frame).alias("ahead"))
    # blocks of running distance: a standing car adds no blocks, only rows of equal distance
    first = reached.groupBy(*keys, "_at").agg(F.min("ahead").alias("ahead"))
    d = timejoin.asof_forward(asked, first, keys, "_want", "_at", ["ahead"], max(marks), tie="ahead", allow_equal=True)
    full = d.groupBy(*keys, frame).agg(F.count("*").alias("_n")).where(F.col("_n") == len(marks)).drop("_n")
    return d.join(full, [*keys, frame], "left_semi").select(*keys, frame, "mark", "ahead")


def lane_beside(poses: DataFrame, lanes: DataFrame, keys: Sequence[str], frame: str, reach: int = 50) -> DataFrame:
    """Per pose and side the lane row, within ``reach`` rows, nearest to the pose's sideways line.

    ``lanes`` is indexed by frame like the poses; the window is [frame - reach, frame + reach).
    """
    keys = list(keys)
    p = poses.select(*keys, frame, *[F.col(c).alias("p" + c) for c in XYZ], "sx", "sy", "sz")
    l = lanes.select(*keys, "side", F.col(frame).alias("lane_frame"), *XYZ)
    near = timejoin.window_join(p, l, keys, frame, "lane_frame", reach, reach - 1)
    rel = [F.col(c) - F.col("p" + c) for c in XYZ]
    dist = rotation.norm(rotation.cross(rel, [F.col("sx"), F.col("sy"), F.col("sz")]))
    best = near.withColumn("_d", dist).groupBy(*keys, frame, "side").agg(F.min(F.struct("_d", "lane_frame", *XYZ)).alias("_b"))
    return best.select(*keys, frame, "side", *[F.col("_b")[c].alias(c) for c in ("lane_frame", *XYZ)])


def labels_ahead(
    poses: DataFrame, lanes: DataFrame, keys: Sequence[str], frame: str, step: str, width: float,
    marks: Sequence[float] = tuple(range(10, 90, 10)), offset: float = 2.0, reach: int = 50,
) -> DataFrame:
    """Future poses, the lane points beside them and their sideways vectors, in the frame of each pose: frame, mark, what, x, y, z.

    ``poses`` holds x, y, z, the rotation r00..r22 and the sideways vector. The
    lane point beside a pose is found once per pose, however many frames look at it.
    """
    keys = list(keys)
    ahead = frames_ahead(poses, keys, frame, step, width, marks, offset)
    beside = lane_beside(poses, lanes, keys, frame, reach).select(*keys, F.col(frame).alias("ahead"), F.col("side").alias("what"), *XYZ)
    centre = poses.select(*keys, F.col(frame).alias("ahead"), F.lit("centre").alias("what"), *XYZ)
    d = ahead.join(beside.unionByName(centre), [*keys, "ahead"])
    own = poses.select(*keys, frame, *[F.col(c).alias("o" + c) for c in XYZ], *[f"r{i}{j}" for i in range(3) for j in range(3)])
    d = d.join(own, [*keys, frame])
    m = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    seen = rotation.rigid_inverse(m, [F.col("o" + c) for c in XYZ], [F.col(c) for c in XYZ])
    points = d.select(*keys, frame, "mark", "what", *[rotation.as_column(s).alias(c) for s, c in zip(seen, XYZ)])
    across = poses.select(*keys, F.col(frame).alias("ahead"), "sx", "sy", "sz")
    turned = rotation.mat_vec(rotation.transpose(m), [F.col("sx"), F.col("sy"), F.col("sz")])
    v = ahead.join(across, [*keys, "ahead"]).join(own, [*keys, frame])
    v = v.select(*keys, frame, "mark", F.lit("sideways").alias("what"), *[rotation.as_column(t).alias(c) for t, c in zip(turned, XYZ)])
    return points.unionByName(v)


def label_vectors(
    labels: DataFrame, keys: Sequence[str], frame: str, marks: Sequence[float], parts: Sequence[str] = ("left", "centre", "right", "sideways")
) -> DataFrame:
    """One flat array per frame: left, centre, right and sideways x, y, z at each mark, in that order.

    The slots are fixed, so each is a plain maximum; no list is gathered.
    """
    slots = []
    for part in parts:
        for mark in marks:
            here = (F.col("what") == part) & (F.col("mark") == float(mark))
            slots += [F.max(F.when(here, F.col(c))) for c in XYZ]
    return labels.groupBy(*keys, frame).agg(F.array(*slots).alias("label"))


#: rows of a window that decayed sums are formed in
DECAY_ROWS = 256


def _decayed(d: DataFrame, keys: Sequence[str], cols: Sequence[str], keep: float, largest: int) -> DataFrame:
    """Columns ``cols`` as running sums over ``pos`` in which each step back counts ``keep`` times less.

    Inside short windows they are sums of scaled values; a window's end counts
    with a power of ``keep`` in the next, which is the same sum over fewer rows.
    """
    if keep < 1e-150:
        return d
    rows = DECAY_ROWS if keep >= 0.3 else max(2, int(-130 / math.log10(keep)))
    d = d.withColumns({"_window": F.floor(F.col("pos") / rows), "_at": (F.col("pos") % rows).cast("double")})
    upto = W.partitionBy(*keys, "_window").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    power = F.pow(F.lit(keep), F.col("_at"))
    d = d.withColumns({c: power * F.sum(F.col(c) / power).over(upto) for c in cols})
    if largest >= rows:
        ends = d.where(F.col("_at") == rows - 1).select(*keys, F.col("_window").alias("pos"), *cols)
        carry = _decayed(ends, keys, cols, keep**rows, largest // rows)
        carry = carry.select(*keys, (F.col("pos") + 1).alias("_window"), *[F.col(c).alias(f"_c_{c}") for c in cols])
        d = d.join(carry, [*keys, "_window"], "left")
        d = d.withColumns({c: F.col(c) + power * keep * F.coalesce(f"_c_{c}", F.lit(0.0)) for c in cols}).drop(*[f"_c_{c}" for c in cols])
    return d.drop("_window", "_at")


def smooth_normals(planes: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], width: float, keep: float = 0.3) -> DataFrame:
    """Running mix along the drive: keep * previous + (1 - keep) * new, starting with the first (``<c>_smooth``).

    Exact for any ``keep`` from 0 to below 1 and drives of any length: a stretch
    of rows is an affine map of the mix before it, and these maps are composed
    level by level, so no window holds more than a few hundred rows.
    """
    if not 0 <= keep < 1:
        raise ValueError("keep lies from 0 to below 1")
    keys, names = list(keys), [f"{c}_smooth" for c in cols]
    d = blocks.row_index(planes.select(*keys, *order, *cols), keys, order, width, "_rn").withColumn("pos", F.col("_rn") - 1).drop("_rn")
    new = {n: F.when(F.col("pos") == 0, F.col(c).cast("double")).otherwise(F.col(c) * (1 - keep)) for n, c in zip(names, cols, strict=True)}
    d = cut_lineage(d.withColumns(new).drop(*cols))
    largest = d.agg(F.max("pos")).first()[0] or 0
    return _decayed(d, keys, names, float(keep), largest).select(*keys, *order, *names)


def resample_lanes(lanes: DataFrame, keys: Sequence[str], time: str, width: float, step_us: int = 10_000, block_rows: int = 4096) -> DataFrame:
    """Natural cubic splines of x, y, z by time, one point per ``step_us`` from each lane's first time.

    Equal times are averaged first. The second derivatives at the knots solve a
    tridiagonal system along the whole lane, exact whatever ``block_rows``; each
    stretch between two knots then gives its points.
    """
    keys = list(keys)
    knots = lanes.groupBy(*keys, time).agg(*[F.avg(c).alias(c) for c in XYZ])
    knots = knots.join(knots.groupBy(*keys).agg(F.min(time).alias("_t0")), keys)
    side = F.struct(F.col(time).alias("t"), *XYZ)
    d = cut_lineage(blocks.fill_around(knots, keys, [time], width, last={"_p": side}, following={"_n": side}, include_current=False))
    before, after = ((a - b) / 1e6 for a, b in ((F.col(time), F.col("_p.t")), (F.col("_n.t"), F.col(time))))
    inner = F.col("_p").isNotNull() & F.col("_n").isNotNull()
    linked = inner & (F.col("_p.t") > F.col("_t0"))  # the knot before is an inner one as well

    def slope_change(c):
        return 6 * ((F.col("_n")[c] - F.col(c)) / after - (F.col(c) - F.col("_p")[c]) / before)

    rows = d.select(
        *keys, time, F.when(inner, 2 * (before + after)).otherwise(1.0).alias("_d0"), F.when(linked, before).otherwise(0.0).alias("_d1"), F.lit(0.0).alias("_d2"),
        *[F.when(inner, slope_change(c)).otherwise(0.0).alias(f"_r{c}") for c in XYZ],
    )
    second = banded.solve_banded(rows, keys, [time], {f"_m{c}": ("_d0", "_d1", "_d2", f"_r{c}") for c in XYZ}, width, block_rows)
    second = cut_lineage(second)
    following = second.select(*keys, F.col(time).alias("_nt"), *[F.col(f"_m{c}").alias(f"_k{c}") for c in XYZ])
    d = d.withColumn("_nt", F.col("_n.t")).join(second, [*keys, time]).join(following, [*keys, "_nt"], "left")
    start, stop = (F.ceil((e - F.col("_t0")) / step_us) for e in (F.col(time), F.coalesce("_nt", F.col(time) + 1)))
    d = d.withColumn("seq", F.explode(F.when(start < stop, F.sequence(start, stop - 1))))
    d = d.withColumn("_at", F.col("_t0") + F.col("seq") * step_us)
    h, a, b = (F.col("_nt") - F.col(time)) / 1e6, (F.col("_nt") - F.col("_at")) / 1e6, (F.col("_at") - F.col(time)) / 1e6

    def curve(c):
        m, k, v, w = F.col(f"_m{c}"), F.col(f"_k{c}"), F.col(c), F.col("_n")[c]
        return m * a * a * a / (6 * h) + k * b * b * b / (6 * h) + (v / h - m * h / 6) * a + (w / h - k * h / 6) * b

    return d.select(*keys, "seq", F.col("_at").alias(time), *[F.when(F.col("_nt").isNull(), F.col(c)).otherwise(curve(c)).alias(c) for c in XYZ])


def fix_lanes(
    lanes: DataFrame, measured: DataFrame, keys: Sequence[str], lane_keys: Sequence[str], seq: str, ident: str, width: float,
    limit: float = 0.25, stiffness: tuple[float, float, float] = (10.0, 10.0, 20.0), block_rows: int = 4096,
) -> DataFrame:
    """Lane points moved to measured points within ``limit`` (weight 2) and smoothed; ``<c>_fixed`` and ``snapped``.

    The smooth lane minimises weighted squared distances plus ``stiffness`` times
    its squared second differences, over the whole lane and exactly, for any
    stiffness and whatever ``block_rows``. Lanes of fewer than three points are
    only moved.
    """
    keys, lane_keys = list(keys), list(lane_keys)
    near = spatial.nearest_within(lanes, measured, keys, XYZ, limit, ident, place="_m_")
    near = near.select(*lane_keys, seq, *[f"_m_{c}" for c in XYZ], F.lit(True).alias("snapped"))
    d = lanes.join(near, [*lane_keys, seq], "left").withColumn("snapped", F.coalesce("snapped", F.lit(False)))
    d = d.select(*lane_keys, seq, "snapped", *XYZ, *[F.coalesce(f"_m_{c}", c).alias(f"_s_{c}") for c in XYZ])
    d = cut_lineage(blocks.running_sum(d, lane_keys, [seq], {"_rn": F.lit(1).cast("bigint")}, width, totals={"_rn": "_rows"}))
    pos, n, weight = F.col("_rn") - 1, F.col("_rows"), F.when(F.col("snapped"), 2.0).otherwise(1.0)

    def one(condition, value):
        return F.when((n >= 3) & condition, F.lit(value)).otherwise(0.0)

    # the diagonals of D'D, with D the second differences
    main = one(pos <= n - 3, 1.0) + one((pos >= 1) & (pos <= n - 2), 4.0) + one(pos >= 2, 1.0)
    first = one((pos >= 1) & (pos <= n - 2), -2.0) + one(pos >= 2, -2.0)
    second = one(pos >= 2, 1.0)
    rows = d.select(
        *lane_keys, seq, *[c.alias(f"_{k}{x}") for x, s in zip(XYZ, stiffness, strict=True) for k, c in (("a", weight + s * main), ("b", s * first), ("c", s * second))],
        *[(weight * F.col(f"_s_{x}")).alias(f"_r{x}") for x in XYZ],
    )
    fixed = banded.solve_banded(rows, lane_keys, [seq], {f"{x}_fixed": (f"_a{x}", f"_b{x}", f"_c{x}", f"_r{x}") for x in XYZ}, width, block_rows)
    return d.select(*lane_keys, seq, "snapped", *XYZ).join(fixed, [*lane_keys, seq])


def lane_error(lanes: DataFrame, measured: DataFrame, keys: Sequence[str], lane_keys: Sequence[str], ident: str, tolerance: float, coords: Sequence[str] = XYZ) -> DataFrame:
    """Median distance of each lane to the measured points (within ``tolerance``)."""
    own = lanes.select(*dict.fromkeys([*keys, *lane_keys]), *[F.col(c).alias(x) for c, x in zip(coords, XYZ)])
    near = spatial.nearest_within(own, measured, keys, XYZ, tolerance, ident)
    return blocks.grouped_median(near, lane_keys, ["dist"], tolerance / 16).withColumnRenamed("dist", "median_error")


def rays_to_planes(rays: DataFrame, planes: DataFrame, keys: Sequence[str], ray: str, plane: str, finest: float = 4.0, ahead: bool = False) -> DataFrame:
    """Image rays (ox..oz, dx..dz) on the plane whose point lies nearest to the hit: ray, plane, x, y, z, dist.

    Planes are nx..nz through px..pz. Every plane of the ray's key counts,
    however far; with ``ahead`` only hits in front of the origin do. A hit lies on
    the ray, so it is no nearer to a plane's point than the ray itself is: cells
    of plane points farther from the ray than the best hit met so far are left
    out, from coarse to fine. Of planes alike the smallest number counts, as on
    ties. Rays parallel to all planes have no row, nor have rays or planes with
    numbers that are not finite, or without a direction.
    """
    keys = list(keys)
    o, u, n, p = (["_" + kind + c for c in XYZ] for kind in "ounp")
    size = rotation.norm([F.col("d" + c) for c in XYZ])
    r = spatial.usable(rays, ["o" + c for c in XYZ] + ["d" + c for c in XYZ]).where(size > 0)
    r = r.select(*keys, ray, *[F.col("o" + c).alias(a) for a, c in zip(o, XYZ)], *[(F.col("d" + c) / size).alias(a) for a, c in zip(u, XYZ)], F.lit(float("inf")).alias("_best"))
    full = ["n" + c for c in XYZ] + ["p" + c for c in XYZ]
    at = spatial.usable(planes, full).groupBy(*keys, *full).agg(F.min(plane).alias(plane))
    at = at.select(*keys, plane, *[F.col("n" + c).alias(a) for a, c in zip(n, XYZ)], *[F.col("p" + c).alias(c) for c in XYZ])
    at = cut_lineage(at.withColumn("_sample", F.struct(plane, *n, *[F.col(c).alias(a) for a, c in zip(p, XYZ)])))
    levels = pyramid.build(at, keys, XYZ, finest, ranges=n, sample="_sample")
    origin, way = [F.col(a) for a in o], [F.col(a) for a in u]

    def hit(normal, point):
        t = F.try_divide(rotation.as_column(rotation.dot([b - a for a, b in zip(origin, point)], normal)), rotation.as_column(rotation.dot(way, normal)))
        t = F.when(t >= 0, t) if ahead else t
        where = [a + t * b for a, b in zip(origin, way)]
        return where, F.sqrt(spatial.dist2(where, point))

    def nearer(d: DataFrame) -> DataFrame:
        rel = [pyramid.middle(c) - a for a, c in zip(origin, XYZ)]
        along = rotation.as_column(rotation.dot(rel, way))
        along = F.greatest(along, F.lit(0.0)) if ahead else along
        bound = F.sqrt(spatial.dist2(rel, [along * b for b in way])) - pyramid.half_diagonal(XYZ)
        # behind the origin for every normal and point of the cell
        behind = F.lit(False)
        if ahead:
            sides = [F.array(*[F.col(f"_{e}_{a}") for e in ("lo", "hi")]) for a in n]
            gaps = [F.array(*[F.col(f"_{e}_{c}") - a for e in ("lo", "hi")]) for a, c in zip(origin, XYZ)]
            num = [F.array(*[x[i] * y[j] for i in (0, 1) for j in (0, 1)]) for x, y in zip(gaps, sides)]
            den = [F.array(*[y[i] * b for i in (0, 1)]) for y, b in zip(sides, way)]
            low, high = ([sum((f(x) for x in part[1:]), f(part[0])) for part in (num, den)] for f in (F.array_min, F.array_max))
            behind = ((low[0] > 0) & (high[1] < 0)) | ((high[0] < 0) & (low[1] > 0))
        _, dist = hit([F.col("_sample")[a] for a in n], [F.col("_sample")[a] for a in p])
        d = d.withColumns({"_bound": bound, "_behind": behind, "_seen": F.coalesce(dist, F.lit(float("inf")))})
        d = d.withColumn("_best", F.least("_best", F.min("_seen").over(W.partitionBy(*keys, ray))))
        return d.where(~F.col("_behind") & (F.col("_bound") <= F.col("_best") * (1 + 1e-9) + 1e-9))

    left = pyramid.descend(r, levels, keys, XYZ, nearer)
    d = left.join(spatial.with_cell(at.drop("_sample"), XYZ, finest), [*keys, *spatial.cell_names(XYZ)])
    where, dist = hit([F.col(a) for a in n], [F.col(c) for c in XYZ])
    d = d.select(*keys, ray, plane, *[w.alias(f"_h{c}") for w, c in zip(where, XYZ)], dist.alias("_d")).where("_d IS NOT NULL")
    best = d.groupBy(*keys, ray).agg(F.min(F.struct("_d", plane, *[F.col(f"_h{c}").alias(c) for c in XYZ])).alias("_b"))
    return best.select(*keys, ray, *[F.col("_b")[c].alias(c) for c in (plane, *XYZ)], F.col("_b._d").alias("dist"))
