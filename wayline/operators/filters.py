"""Point and radar filters, sensor expansions and moves to the map frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions import camera, geodesy, rotation
from wayline.functions.can import lane_polynomial
from wayline.operators import timejoin, trace

LIDAR_HEIGHT = 2.0


def _distance() -> Column:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return F.sqrt(x * x + y * y + z * z)


def _between(col: str, low: float, high: float) -> Column:
    return (F.col(col) > low) & (F.col(col) < high)


def preset(name: str) -> Column:
    """Named point-quality condition; the limits are fixed values in metres and intensity units."""
    conditions = {
        "default": F.col("intensity") > 30,
        "ground": F.col("intensity") < 10,
        "lanes": _between("y", -3, 3) & _between("z", -2.1, -1.9),
        "forward": F.col("x") > 0,
        "no-trees": _between("y", -30, 30) & _between("z", -3, -1),
        "flat": F.lit(True),
        "roof": _distance() > 3,
        "above-ground-limit": F.col("z") > -5,
        "near-lanes": (_distance() > 3) & (F.col("intensity") > 40) & _between("z", -2.5, -1.8)
        & (F.abs("y") > 1.2) & (F.abs("y") < 2.2),
        "left-lane": (_distance() > 3) & (_distance() < 10) & (F.col("intensity") > 40) & _between("y", 1.2, 2.2)
        & _between("z", -LIDAR_HEIGHT - 0.1, -LIDAR_HEIGHT + 0.1),
        "right-lane": (_distance() > 3) & (_distance() < 10) & (F.col("intensity") > 40) & _between("y", -2.4, -1.4)
        & _between("z", -LIDAR_HEIGHT - 0.1, -LIDAR_HEIGHT + 0.1),
    }
    return conditions[name]


def apply_presets(points: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Points that meet all presets; ``flat`` then sets x to 0; no names, no filter."""
    out = points
    for name in names or ():
        out = out.where(preset(name))
    return out.withColumn("x", F.lit(0.0)) if names and "flat" in names else out


def plausible_radar(min_rcs: float = 0.0, min_speed: float = -20.0) -> Column:
    return (F.col("rcs") > min_rcs) & (F.col("rel_spd") > min_speed)


def pass_through(limits: Mapping[str, tuple[float, float]]) -> Column:
    """Every named field inside its closed range."""
    keep = F.lit(True)
    for field, (low, high) in limits.items():
        keep = keep & F.col(field).between(low, high)
    return keep


def radar_box_corners(radar: DataFrame, dist: str, lat: str, length: str, width: str) -> DataFrame:
    """Four rows per object: front then back, each right (+) then left; columns corner, cx, cy."""
    out = radar.withColumn("corner", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    front, right = F.col("corner") < 2, F.col("corner") % 2 == 0
    half = F.col(width) / 2
    return out.withColumns(
        {
            "cx": F.when(front, F.col(dist) + F.col(length)).otherwise(F.col(dist)),
            "cy": F.when(right, F.col(lat) + half).otherwise(F.col(lat) - half),
        }
    )


def sample_lanes(lanes: DataFrame, per_metre: int = 3) -> DataFrame:
    """Points along vision lanes (c0..c3, view_range): ``seq, x, y``, three a metre, both ends included."""
    n = F.floor(F.col("view_range") * per_metre).cast("int")
    d = lanes.where("view_range > 0").where(n > 0).withColumn("_n", n)
    d = d.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = F.when(F.col("_n") > 1, F.col("view_range") / F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(F.lit(0.0))
    d = d.withColumn("x", F.col("seq") * step)
    return d.withColumn("y", lane_polynomial(F.col("x"), *[F.col(f"c{i}") for i in range(4)])).drop("_n")


def to_map_frame(
    points: DataFrame,
    poses: DataFrame,
    keys: Sequence[str],
    point_time: str,
    pose_time: str,
    quat: Sequence[str],
    position: Sequence[str],
    coords: Sequence[str],
    width: float,
) -> DataFrame:
    """Move points to the map frame by the pose at their own time (``<coord>_map``).

    Poses around each distinct time are found once; the position is mixed
    linearly and the rotation along the shorter arc.
    """
    d = timejoin.bracket_join(points, poses, keys, point_time, pose_time, [*quat, *position], width)
    one, two = [F.col(f"{c}_1") for c in quat], [F.col(f"{c}_2") for c in quat]
    d = d.withColumn("_cos", rotation.dot(one, two))
    w1, w2 = rotation.slerp_weights(F.col("_cos"), F.col("f"))
    d = d.withColumns({"_w1": w1, "_w2": w2})
    d = d.withColumns({f"_q{i}": F.col("_w1") * a + F.col("_w2") * b for i, (a, b) in enumerate(zip(one, two))})
    turn = rotation.quat_matrix([F.col(f"_q{i}") for i in range(4)])
    moved = rotation.rigid(turn, [timejoin.lerp(f"{c}_1", f"{c}_2") for c in position], [F.col(c) for c in coords])
    return d.select(*points.columns, *[rotation.as_column(m).alias(f"{c}_map") for c, m in zip(coords, moved)])


def deskew_by_offset(
    points: DataFrame, poses: DataFrame, keys: Sequence[str], frame: str, dt_us: str, pose_idx: str,
    quat: Sequence[str], position: Sequence[str], coords: Sequence[str], spacing_s: float = 0.05, max_steps: float = 5.0,
) -> DataFrame:
    """Older deskew: the pose ``dt / spacing`` steps before the frame, at most ``max_steps``.

    Both neighbours are fetched by equi-joins on their row number. Before pose 0
    the motion is mirrored: pose -k is pose 0 minus (pose k - pose 0), with the
    rotation undone likewise.
    """
    keys = list(keys)
    offset = F.least(F.col(dt_us) / F.lit(1e6) / F.lit(spacing_s), F.lit(max_steps))
    d = points.withColumn("_offset", offset).withColumns(
        {"_i1": F.col(frame) - F.ceil("_offset"), "_i2": F.col(frame) - F.floor("_offset")}
    )
    cols = [*quat, *position]
    zero = poses.where(F.col(pose_idx) == 0).select(*keys, *[F.col(c).alias(f"_z_{c}") for c in cols])
    d = d.join(zero, keys)
    for side in ("1", "2"):
        p = poses.select(*keys, F.col(pose_idx).alias("_want"), *[F.col(c).alias(f"_p_{c}") for c in cols])
        d = d.withColumn("_want", F.abs(f"_i{side}")).join(p, [*keys, "_want"]).drop("_want")
        before = F.col(f"_i{side}") < 0
        origin = [F.col(f"_z_{c}") for c in quat]
        found = [F.col(f"_p_{c}") for c in quat]
        conj = [found[0], -found[1], -found[2], -found[3]]
        mirrored = rotation.quat_mul(rotation.quat_mul(origin, conj), origin)
        d = d.withColumns(
            {
                **{f"_s{side}_{c}": F.when(before, m).otherwise(p_) for c, m, p_ in zip(quat, mirrored, found)},
                **{
                    f"_s{side}_{c}": F.when(before, 2 * F.col(f"_z_{c}") - F.col(f"_p_{c}")).otherwise(F.col(f"_p_{c}"))
                    for c in position
                },
            }
        ).drop(*[f"_p_{c}" for c in cols])
    # share of the way from the earlier pose (1) to the later one (2)
    d = d.withColumn("_f", F.ceil("_offset") - F.col("_offset"))
    one, two = [F.col(f"_s1_{c}") for c in quat], [F.col(f"_s2_{c}") for c in quat]
    w1, w2 = rotation.slerp_weights(rotation.dot(one, two), F.col("_f"))
    d = d.withColumns({"_w1": w1, "_w2": w2})
    turn = rotation.quat_matrix([F.col("_w1") * a + F.col("_w2") * b for a, b in zip(one, two)])
    shift = [(1 - F.col("_f")) * F.col(f"_s1_{c}") + F.col("_f") * F.col(f"_s2_{c}") for c in position]
    moved = rotation.rigid(turn, shift, [F.col(c) for c in coords])
    return d.select(*points.columns, *[rotation.as_column(m).alias(f"{c}_map") for c, m in zip(coords, moved)])


def lane_labels_to_wgs84(
    labels: DataFrame, poses: DataFrame, keys: Sequence[str], frame: str, order: Sequence[str],
    focal, centre, camera_height: float,
) -> DataFrame:
    """Labelled lane pixels (u, v) to coordinates: flat road, vehicle, first pose's frame, WGS84.

    Adds label_lat, label_lon, label_height and the run's reference lat_0, lon_0, height_0.
    """
    p = trace.with_first(poses, keys, order, trace.POSE)
    d = labels.join(p.select(*keys, frame, *trace.POSE, *[c + "_0" for c in trace.POSE]), [*keys, frame])
    road = camera.flat_road_point(camera.pixel_ray(F.col("u"), F.col("v"), focal, centre), camera_height)
    vehicle = [road[2], -road[0], -road[1]]
    own = rotation.attitude(F.col("rot_x"), F.col("rot_y"), F.col("azimuth"))
    first = rotation.attitude(F.col("rot_x_0"), F.col("rot_y_0"), F.col("azimuth_0"))
    ref = [F.col(c) for c in ("lat_0", "lon_0", "height_0")]
    here = geodesy.wgs84_to_enu(F.col("lat"), F.col("lon"), F.col("height"), ref)
    d = d.withColumns({f"_h{i}": c for i, c in enumerate(here)})
    d = d.withColumns({f"_v{i}": rotation.as_column(c) for i, c in enumerate(rotation.mat_vec(rotation.transpose(own), vehicle))})
    in_first = rotation.mat_vec(first, [F.col(f"_h{i}") + F.col(f"_v{i}") for i in range(3)])
    d = d.withColumns({f"_f{i}": rotation.as_column(c) for i, c in enumerate(in_first)})
    enu = rotation.mat_vec(rotation.transpose(first), [F.col(f"_f{i}") for i in range(3)])
    d = d.withColumns({f"_e{i}": rotation.as_column(c) for i, c in enumerate(enu)})
    names = ("label_lat", "label_lon", "label_height")
    d = geodesy.with_enu_to_wgs84(d, [F.col(f"_e{i}") for i in range(3)], ref, names)
    return d.select(*labels.columns, "lat_0", "lon_0", "height_0", *names)


def distance_shell(pairs: DataFrame, dist: str, inner: float, outer: float) -> DataFrame:
    """Points between two ranges of the pose they are paired with."""
    return pairs.where(F.col(dist).between(inner, outer))
