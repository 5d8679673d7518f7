"""Coordinates, cameras and decoded payloads as column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import camera, can, geodesy, rotation, text
from wayline.operators import filters, timejoin, trace
from wayline.plans.inputs import DAY_US, POINTS, POSES, points, poses, q, qs, table
from wayline.plans.registry import query

REF = (37.05, -121.95, 20.0)
BLOCK_US = 5 * DAY_US


def _ref():
    return [F.lit(v) for v in REF]


def cols(names_values, digits=4):
    return [q(rotation.as_column(v), digits).alias(n) for n, v in names_values]


# --- SQL pieces -----------------------------------------------------------------------------------

_A = "6378137e0"
_F = "(1e0 / 298.257223563e0)"
_E2 = f"(2e0 * {_F} - {_F} * {_F})"


def ecef_sql(lat: str, lon: str, h: str) -> list[str]:
    chi = f"sqrt(1e0 - {_E2} * power(sin(radians({lat})), 2))"
    return [
        f"(({_A} / {chi} + {h}) * cos(radians({lat})) * cos(radians({lon})))",
        f"(({_A} / {chi} + {h}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({_A} * (1e0 - {_E2}) / {chi} + {h}) * sin(radians({lat})))",
    ]


def enu_sql(d: list[str], lat: str, lon: str) -> list[str]:
    sl, cl, so, co = f"sin(radians({lat}))", f"cos(radians({lat}))", f"sin(radians({lon}))", f"cos(radians({lon}))"
    return [
        f"(-{so} * {d[0]} + {co} * {d[1]})",
        f"(-{sl} * {co} * {d[0]} - {sl} * {so} * {d[1]} + {cl} * {d[2]})",
        f"({cl} * {co} * {d[0]} + {cl} * {so} * {d[1]} + {sl} * {d[2]})",
    ]


def attitude_sql(rx: str, ry: str, az: str) -> list[list[str]]:
    ct, st = f"cos(radians({rx}))", f"sin(radians({rx}))"
    cp, sp = f"cos(radians({ry}))", f"sin(radians({ry}))"
    cg, sg = f"cos(radians(-({az})))", f"sin(radians(-({az})))"
    return [
        [f"({cg} * {cp} - {sg} * {st} * {sp})", f"({sg} * {cp} + {cg} * {st} * {sp})", f"(-{ct} * {sp})"],
        [f"(-{sg} * {ct})", f"({cg} * {ct})", st],
        [f"({cg} * {sp} + {sg} * {st} * {cp})", f"({sg} * {sp} - {cg} * {st} * {cp})", f"({ct} * {cp})"],
    ]


def dot_sql(a, b) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


RXYZ = ecef_sql(*[f"({v}e0)" for v in REF])
XYZ = ecef_sql("lat", "lon", "height")
ENU = enu_sql([f"({a} - {b})" for a, b in zip(XYZ, RXYZ)], f"{REF[0]}e0", f"({REF[1]}e0)")


def select_sql(pairs, digits=4) -> str:
    return ", ".join(f"{qs(e, digits)} AS {n}" for n, e in pairs)


# --- coordinates ----------------------------------------------------------------------------------


@query(
    "gps_time",
    """SELECT event_id, CAST(floor(((1786 + event_id % 10) * 604800 + value * 100 + 315964800 - 16) * 1e6) AS BIGINT) AS t_us FROM events""",
)
def gps_time(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", geodesy.gps_to_utc_us(1786 + F.col("event_id") % 10, F.col("value") * 100).alias("t_us"))


@query("ecef", f"WITH {POSES} SELECT idx, {select_sql(zip('xyz', XYZ), 3)} FROM poses")
def ecef(spark, sf):
    xyz = geodesy.wgs84_to_ecef(F.col("lat"), F.col("lon"), F.col("height"))
    return poses(spark, sf).select("idx", *cols(zip("xyz", xyz), 3))


@query(
    "ecef_round_trip",
    f"WITH {POSES} SELECT idx, {select_sql([('lat', 'lat'), ('lon', 'lon')], 8)}, {qs('height', 4)} AS height FROM poses",
)
def ecef_round_trip(spark, sf):
    """Forward and closed-form inverse together give the input back."""
    xyz = geodesy.wgs84_to_ecef(F.col("lat"), F.col("lon"), F.col("height"))
    d = geodesy.with_wgs84(poses(spark, sf).select("idx", "lat", "lon", "height"), xyz)
    return d.select("idx", *cols([("lat", F.col("lat")), ("lon", F.col("lon"))], 8), *cols([("height", F.col("height"))], 4))


@query("enu", f"WITH {POSES} SELECT idx, {select_sql(zip(('east', 'north', 'up'), ENU), 3)} FROM poses")
def enu(spark, sf):
    e = geodesy.wgs84_to_enu(F.col("lat"), F.col("lon"), F.col("height"), _ref())
    return poses(spark, sf).select("idx", *cols(zip(("east", "north", "up"), e), 3))


@query(
    "enu_to_wgs84",
    f"WITH {POSES} SELECT idx, {select_sql([('lat', 'lat'), ('lon', 'lon')], 8)}, {qs('height', 4)} AS height FROM poses",
)
def enu_to_wgs84(spark, sf):
    e = geodesy.wgs84_to_enu(F.col("lat"), F.col("lon"), F.col("height"), _ref())
    d = poses(spark, sf).select("idx", *[c.alias(n) for n, c in zip("enu", e)])
    d = geodesy.with_enu_to_wgs84(d, [F.col(n) for n in "enu"], _ref())
    return d.select("idx", *cols([("lat", F.col("lat")), ("lon", F.col("lon"))], 8), *cols([("height", F.col("height"))], 4))


_SE2 = "(1e0 - power(6356752.3142e0 / 6378137e0, 2))"
_SP, _CP = f"sin(radians({REF[0]}e0))", f"cos(radians({REF[0]}e0))"
_T1 = f"sqrt(1e0 - {_SE2} * power({_SP}, 2))"
_DP, _DL, _DH = f"(radians(lat) - radians({REF[0]}e0))", f"(radians(lon) - radians({REF[1]}e0))", f"(height - {REF[2]}e0)"
_H0 = f"{REF[2]}e0"
SERIES = [
    f"(({_A} / {_T1} + {_H0}) * {_CP} * {_DL} - ({_A} * (1e0 - {_SE2}) / power({_T1}, 3) + {_H0}) * {_SP} * {_DP} * {_DL} + {_CP} * {_DL} * {_DH})",
    f"(({_A} * (1e0 - {_SE2}) / power({_T1}, 3) + {_H0}) * {_DP} + 1.5e0 * {_CP} * {_SP} * {_A} * {_SE2} * power({_DP}, 2) + power({_SP}, 2) * {_DH} * {_DP} + 0.5e0 * {_SP} * {_CP} * ({_A} / {_T1} + {_H0}) * power({_DL}, 2))",
    f"({_DH} - 0.5e0 * ({_A} - 1.5e0 * {_A} * {_SE2} * power({_CP}, 2) + 0.5e0 * {_A} * {_SE2} + {_H0}) * power({_DP}, 2) - 0.5e0 * power({_CP}, 2) * ({_A} / {_T1} - {_H0}) * power({_DL}, 2))",
]


@query("enu_series", f"WITH {POSES} SELECT idx, {select_sql(zip(('east', 'north', 'up'), SERIES), 3)} FROM poses")
def enu_series(spark, sf):
    e = geodesy.wgs84_to_enu_series(F.col("lat"), F.col("lon"), F.col("height"), _ref())
    return poses(spark, sf).select("idx", *cols(zip(("east", "north", "up"), e), 3))


ATT = attitude_sql("rot_x", "rot_y", "azimuth")
R_NAMES = [(f"r{i}{j}", (i, j)) for i in range(3) for j in range(3)]


@query("attitude", f"WITH {POSES} SELECT idx, {select_sql([(n, ATT[i][j]) for n, (i, j) in R_NAMES], 6)} FROM poses")
def attitude(spark, sf):
    m = rotation.attitude(F.col("rot_x"), F.col("rot_y"), F.col("azimuth"))
    return poses(spark, sf).select("idx", *cols([(n, m[i][j]) for n, (i, j) in R_NAMES], 6))


VEL = ["v_east", "v_north", "v_up"]


@query("vehicle_velocity", f"WITH {POSES} SELECT idx, {select_sql([(f'v{a}', dot_sql(ATT[i], VEL)) for i, a in enumerate('xyz')])} FROM poses")
def vehicle_velocity(spark, sf):
    """Velocity turned from east, north, up into the vehicle frame."""
    m = rotation.attitude(F.col("rot_x"), F.col("rot_y"), F.col("azimuth"))
    v = rotation.mat_vec(m, [F.col(c) for c in VEL])
    return poses(spark, sf).select("idx", *cols(zip(("vx", "vy", "vz"), v)))


# one lidar mounting: turn about the up axis and shift
MOUNT_YAW, MOUNT_SHIFT = 0.02, (1.6, -0.2, 1.9)


@query(
    "rigid_transform",
    f"""WITH {POINTS}, d AS (SELECT point_id, sweep, x, y, z, cos(0.02e0) * x - sin(0.02e0) * y + 1.6e0 AS tx, sin(0.02e0) * x + cos(0.02e0) * y - 0.2e0 AS ty, z + 1.9e0 AS tz FROM points)
SELECT point_id, sweep, {select_sql([('tx', 'tx'), ('ty', 'ty'), ('tz', 'tz')])}, {select_sql([('bx', 'x'), ('by', 'y'), ('bz', 'z')], 5)} FROM d""",
)
def rigid_transform(spark, sf):
    m, t = rotation.turn(2, F.lit(MOUNT_YAW)), MOUNT_SHIFT
    p = rotation.rigid(m, t, [F.col(c) for c in "xyz"])
    back = rotation.rigid_inverse(m, t, p)
    return points(spark, sf).select("point_id", "sweep", *cols(zip(("tx", "ty", "tz"), p)), *cols(zip(("bx", "by", "bz"), back), 5))


@query(
    "sensor_frames",
    f"""WITH {POINTS}, d AS (SELECT point_id, sweep, x + 3.17e0 AS a, y + 0.4e0 AS b, z - 1.64e0 AS c FROM points)
SELECT point_id, sweep, {select_sql([('x_imu0', 'cos(0.01e0) * a - sin(0.01e0) * b'), ('y_imu0', 'sin(0.01e0) * a + cos(0.01e0) * b'), ('z_imu0', 'c')])} FROM d""",
)
def sensor_frames(spark, sf):
    """Radar and vision returns: shift to the mounting point, then turn."""
    p = camera.shift_then_rotate([F.col(c) for c in "xyz"], (3.17, 0.4, -1.64), rotation.turn(2, F.lit(0.01)))
    return points(spark, sf).select("point_id", "sweep", *cols(zip(("x_imu0", "y_imu0", "z_imu0"), p)))


# one camera: looks along x, 1280 x 960
FOCAL, CENTRE, DISTORT, IMAGE = (1200.0, 1190.0), (640.0, 480.0), (-0.25, 0.08, 0.001, -0.0005, 0.01), (1280, 960)
TO_CAMERA = [[0, -1, 0], [0, 0, -1], [1, 0, 0]]


def projected_sql(x: str, y: str, z: str) -> str:
    """Pixel of a camera point under the distortion above, as columns u, v over a point (x, y, z)."""
    u = f"({x} / {z})"
    v = f"({y} / {z})"
    r2 = f"({u} * {u} + {v} * {v})"
    rad = f"(1e0 + -0.25e0 * {r2} + 0.08e0 * power({r2}, 2) + 0.01e0 * power({r2}, 3))"
    return (
        f"1200e0 * ({u} * {rad} + 2e0 * 0.001e0 * {u} * {v} + -0.0005e0 * ({r2} + 2e0 * {u} * {u})) + 640e0 AS u, "
        f"1190e0 * ({v} * {rad} + 0.001e0 * ({r2} + 2e0 * {v} * {v}) + 2e0 * -0.0005e0 * {u} * {v}) + 480e0 AS v"
    )


VISIBLE_SQL = "round_even(u, 0) > 2 AND round_even(u, 0) < 1277 AND round_even(v, 0) > 2 AND round_even(v, 0) < 957 AND c > 0 AND a * a + b * b + c * c > 3"


@query(
    "camera_projection",
    f"""WITH {POINTS}, d AS (SELECT point_id, sweep, -(y - 50) AS a, -(z - 5) AS b, x - 2 AS c FROM points),
e AS (SELECT point_id, sweep, a, b, c, {projected_sql('a', 'b', 'c')} FROM d WHERE c > 0)
SELECT point_id, sweep, {select_sql([('u', 'u'), ('v', 'v')], 3)} FROM e WHERE {VISIBLE_SQL}""",
)
def camera_projection(spark, sf):
    p = rotation.mat_vec(TO_CAMERA, [F.col("x") - 2, F.col("y") - 50, F.col("z") - 5])
    d = camera.with_pixels(points(spark, sf).select("point_id", "sweep", "x", "y", "z"), p, FOCAL, CENTRE, DISTORT)
    return d.where(camera.visible(*IMAGE)).select("point_id", "sweep", *cols([("u", F.col("u")), ("v", F.col("v"))], 3))


PIXELS = ["(l_orderkey * 37) % 1280 AS u", "500 + (l_suppkey * 53 + l_linenumber) % 460 AS v"]
LINE_ID = "((l_orderkey * 8 + l_linenumber) * 2000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS point_id"


@query(
    "back_projection",
    f"""WITH d AS (SELECT l_partkey AS sweep, {LINE_ID}, ({PIXELS[0][:-5]} - 640e0) / 1200e0 AS a, ({PIXELS[1][:-5]} - 480e0) / 1190e0 AS b, l_tax AS t FROM lineitem),
e AS (SELECT *, (0.01e0 * 0 + t * 0.5e0 + 1.7e0) / NULLIF(0.01e0 * a + b + 0.02e0, 0) AS s FROM d)
SELECT sweep, point_id, {select_sql([('road_x', 'a * (1.105e0 / b)'), ('road_z', '1.105e0 / b')])}, {select_sql([('hit_x', 'a * s'), ('hit_y', 'b * s'), ('hit_z', 's')], 3)} FROM e""",
)
def back_projection(spark, sf):
    """Pixels to the flat road, and to a sloping plane by ray intersection."""
    d = table(spark, sf, "lineitem").selectExpr("l_partkey AS sweep", LINE_ID, *PIXELS, "l_tax")
    ray = camera.pixel_ray(F.col("u"), F.col("v"), FOCAL, CENTRE)
    road = camera.flat_road_point(ray, 1.105)
    normal = (0.01, 1.0, 0.02)
    hit = camera.ray_on_plane((0, 0, 0), ray, normal, (0, F.col("l_tax") * 0.5 + 1.7, 0))
    return d.select(
        "sweep", "point_id", *cols([("road_x", road[0]), ("road_z", road[2])]), *cols(zip(("hit_x", "hit_y", "hit_z"), hit), 3)
    )


FIRST_SQL = """first AS (SELECT run_id, arg_min(rot_x, (t_us, idx)) AS rot_x_0, arg_min(rot_y, (t_us, idx)) AS rot_y_0, arg_min(azimuth, (t_us, idx)) AS azimuth_0,
 arg_min(lat, (t_us, idx)) AS lat_0, arg_min(lon, (t_us, idx)) AS lon_0, arg_min(height, (t_us, idx)) AS height_0, min(t_us) AS t_0 FROM poses GROUP BY run_id)"""
ATT0 = attitude_sql("rot_x_0", "rot_y_0", "azimuth_0")
BASE_SQL = ", ".join(f"{ATT0[i][j]} AS b{i}{j}" for _, (i, j) in R_NAMES) + ", " + ", ".join(f"{ATT[i][j]} AS m{i}{j}" for _, (i, j) in R_NAMES)
REL_SQL = select_sql([(n, dot_sql([f"b{i}{k}" for k in range(3)], [f"m{j}{k}" for k in range(3)])) for n, (i, j) in R_NAMES], 6)


@query(
    "relative_poses",
    f"""WITH {POSES}, {FIRST_SQL}, step AS (SELECT p.run_id, (min(p.t_us) - min(f.t_0)) / 1e6 AS dt FROM poses p JOIN first f ON p.run_id = f.run_id AND p.t_us > f.t_0 GROUP BY p.run_id),
d AS (SELECT p.run_id, idx, sum(v_east * dt) OVER w AS e, sum(v_north * dt) OVER w AS n, sum(v_up * dt) OVER w AS u, {BASE_SQL}
 FROM poses p JOIN first f ON p.run_id = f.run_id JOIN step s ON p.run_id = s.run_id WINDOW w AS (PARTITION BY p.run_id ORDER BY t_us, idx))
SELECT run_id, idx, {select_sql([(f'p{a}', dot_sql([f'b{i}0', f'b{i}1', f'b{i}2'], ['e', 'n', 'u'])) for i, a in enumerate('xyz')], 1)}, {REL_SQL} FROM d""",
)
def relative_poses(spark, sf):
    d = trace.integrate_velocity(poses(spark, sf), ["run_id"], ["t_us", "idx"], BLOCK_US)
    return d.select("run_id", "idx", *cols([(c, F.col(c)) for c in ("px", "py", "pz")], 1), *cols([(n, F.col(n)) for n, _ in R_NAMES], 6))


ENU0 = enu_sql([f"({a} - {b})" for a, b in zip(XYZ, ecef_sql("lat_0", "lon_0", "height_0"))], "lat_0", "lon_0")


@query(
    "absolute_poses",
    f"""WITH {POSES}, {FIRST_SQL}, d AS (SELECT p.run_id, idx, {ENU0[0]} AS e, {ENU0[1]} AS n, {ENU0[2]} AS u, {BASE_SQL} FROM poses p JOIN first f ON p.run_id = f.run_id)
SELECT run_id, idx, {select_sql([(f'p{a}', dot_sql([f'b{i}0', f'b{i}1', f'b{i}2'], ['e', 'n', 'u'])) for i, a in enumerate('xyz')], 3)}, {REL_SQL} FROM d""",
)
def absolute_poses(spark, sf):
    d = trace.absolute_poses(poses(spark, sf), ["run_id"], ["t_us", "idx"])
    return d.select("run_id", "idx", *cols([(c, F.col(c)) for c in ("px", "py", "pz")], 3), *cols([(n, F.col(n)) for n, _ in R_NAMES], 6))


@query(
    "sideways_vector",
    f"WITH {POSES} SELECT idx, {select_sql([('sx', 'v_north / nullif(sqrt(v_east * v_east + v_north * v_north), 0)'), ('sy', '-v_east / nullif(sqrt(v_east * v_east + v_north * v_north), 0)')], 6)} FROM poses",
)
def sideways_vector(spark, sf):
    s = trace.sideways(F.col("v_east"), F.col("v_north"))
    return poses(spark, sf).select("idx", *cols(zip(("sx", "sy"), s), 6))


LLH = ["lat", "lon", "height"]


@query(
    "interpolated_positions",
    f"""WITH {POSES}, v AS (SELECT run_id, t_us, lat, lon, height, lead(t_us) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(height) OVER w AS h2
 FROM poses WHERE kind = 'view' WINDOW w AS (PARTITION BY run_id ORDER BY t_us)),
j AS (SELECT p.run_id, p.idx, v.*, CAST(p.t_us - v.t_us AS DOUBLE) / (v.t2 - v.t_us) AS f FROM (SELECT * FROM poses WHERE kind <> 'view') p
 JOIN v ON p.run_id = v.run_id AND p.t_us >= v.t_us AND p.t_us < v.t2)
SELECT run_id, idx, {select_sql([('lat', '(1 - f) * lat + f * lat2'), ('lon', '(1 - f) * lon + f * lon2')], 7)}, {qs('(1 - f) * height + f * h2')} AS height FROM j""",
)
def interpolated_positions(spark, sf):
    p = poses(spark, sf).select("run_id", "idx", "t_us", "kind", *LLH)
    pts = p.where("kind <> 'view'").select("run_id", "idx", "t_us")
    d = timejoin.bracket_join(pts, p.where("kind = 'view'"), ["run_id"], "t_us", "t_us", LLH, BLOCK_US)
    mixed = {c: timejoin.lerp(f"{c}_1", f"{c}_2") for c in LLH}
    return d.select("run_id", "idx", *cols([(c, mixed[c]) for c in LLH[:2]], 7), *cols([("height", mixed["height"])]))


def quat_sql(rx: str, ry: str, az: str) -> list[str]:
    c1, s1 = f"cos(radians(-({az})) / 2)", f"sin(radians(-({az})) / 2)"
    c2, s2 = f"cos(radians({rx}) / 2)", f"sin(radians({rx}) / 2)"
    c3, s3 = f"cos(radians({ry}) / 2)", f"sin(radians({ry}) / 2)"
    return [
        f"({c1} * {c2} * {c3} - {s1} * {s2} * {s3})",
        f"({c1} * {s2} * {c3} - {s1} * {c2} * {s3})",
        f"({c1} * {c2} * {s3} + {s1} * {s2} * {c3})",
        f"({s1} * {c2} * {c3} + {c1} * {s2} * {s3})",
    ]


Q_SQL = quat_sql("rot_x", "rot_y", "azimuth")


@query(
    "deskewed_points",
    f"""WITH {POSES}, v AS (SELECT run_id, t_us, height, lead(t_us) OVER w AS t2, lead(height) OVER w AS h2, {', '.join(f'{e} AS a{i}' for i, e in enumerate(Q_SQL))},
 {', '.join(f'lead({e}) OVER w AS b{i}' for i, e in enumerate(Q_SQL))} FROM poses WHERE kind = 'view' WINDOW w AS (PARTITION BY run_id ORDER BY t_us)),
j AS (SELECT p.run_id, p.idx, v.*, CAST(p.t_us - v.t_us AS DOUBLE) / (v.t2 - v.t_us) AS f, a0 * b0 + a1 * b1 + a2 * b2 + a3 * b3 AS dp,
 p.v_north AS x, p.v_east AS y, p.v_up AS z FROM (SELECT * FROM poses WHERE kind <> 'view') p JOIN v ON p.run_id = v.run_id AND p.t_us >= v.t_us AND p.t_us < v.t2),
k AS (SELECT *, acos(least(abs(dp), 1e0)) AS th FROM j),
l AS (SELECT *, CASE WHEN sin(th) < 1e-9 THEN 1 - f ELSE sin((1 - f) * th) / sin(th) END AS w1,
 CASE WHEN dp < 0 THEN -1 ELSE 1 END * CASE WHEN sin(th) < 1e-9 THEN f ELSE sin(f * th) / sin(th) END AS w2 FROM k),
m AS (SELECT run_id, idx, x, y, z, (1 - f) * height + f * h2 AS h, {', '.join(f'w1 * a{i} + w2 * b{i} AS q{i}' for i in range(4))} FROM l)
SELECT run_id, idx, {select_sql([
    ('x_imu0', '(1 - 2 * (q2 * q2 + q3 * q3)) * x + 2 * (q1 * q2 - q3 * q0) * y + 2 * (q1 * q3 + q2 * q0) * z'),
    ('y_imu0', '2 * (q1 * q2 + q3 * q0) * x + (1 - 2 * (q1 * q1 + q3 * q3)) * y + 2 * (q2 * q3 - q1 * q0) * z'),
    ('z_imu0', '2 * (q1 * q3 - q2 * q0) * x + 2 * (q2 * q3 + q1 * q0) * y + (1 - 2 * (q1 * q1 + q2 * q2)) * z + h')])} FROM m""",
)
def deskewed_points(spark, sf):
    """Points moved to the map frame with the pose interpolated at their own time."""
    p = poses(spark, sf)
    pts = p.where("kind <> 'view'").select(
        "run_id", "idx", "t_us", F.col("v_north").alias("x"), F.col("v_east").alias("y"), F.col("v_up").alias("z")
    )
    quat = rotation.attitude_quat(F.col("rot_x"), F.col("rot_y"), F.col("azimuth"))
    names = [f"q{i}" for i in range(4)]
    views = p.where("kind = 'view'").select(
        "run_id", "t_us", F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.col("height").alias("pz"),
        *[rotation.as_column(c).alias(n) for n, c in zip(names, quat)],
    )
    d = filters.to_map_frame(pts, views, ["run_id"], "t_us", "t_us", names, ["px", "py", "pz"], ["x", "y", "z"], BLOCK_US)
    return d.select("run_id", "idx", *cols([(f"{a}_imu0", F.col(f"{a}_map")) for a in "xyz"]))


# --- sensors --------------------------------------------------------------------------------------


@query(
    "radar_corners",
    f"""WITH {POINTS}, r AS (SELECT point_id, sweep, x + 5 AS dist, y - 50 AS lat, z AS l, intensity / 20 AS w FROM points),
k AS (SELECT point_id, sweep, 0 AS corner, dist + l AS px, lat + w / 2 AS py FROM r UNION ALL SELECT point_id, sweep, 1, dist + l, lat - w / 2 FROM r
 UNION ALL SELECT point_id, sweep, 2, dist, lat + w / 2 FROM r UNION ALL SELECT point_id, sweep, 3, dist, lat - w / 2 FROM r),
d AS (SELECT point_id, sweep, corner, -py AS a, 1.64e0 AS b, px AS c FROM k), e AS (SELECT *, {projected_sql('a', 'b', 'c')} FROM d)
SELECT point_id, sweep, corner, {select_sql([('u', 'u'), ('v', 'v')], 2)} FROM e WHERE {VISIBLE_SQL}""",
)
def radar_corners(spark, sf):
    r = points(spark, sf).selectExpr("point_id", "sweep", "x + 5 AS dist", "y - 50 AS lat", "z AS l", "intensity / 20 AS w")
    d = filters.radar_box_corners(r, "dist", "lat", "l", "w")
    p = rotation.mat_vec(TO_CAMERA, [F.col("cx"), F.col("cy"), F.lit(-1.64)])
    d = camera.with_pixels(d, p, FOCAL, CENTRE, DISTORT).where(camera.visible(*IMAGE))
    return d.select("point_id", "sweep", "corner", *cols([("u", F.col("u")), ("v", F.col("v"))], 2))


@query(
    "lane_samples",
    f"""WITH {POSES}, d AS (SELECT idx, v_north / 3.7e0 AS c0, v_east / 97 AS c1, v_up / 1000 AS c2, rot_x / 9973 AS c3, idx % 5 AS r FROM poses),
e AS (SELECT *, unnest(range(0, r * 3)) AS i FROM d WHERE r > 0), g AS (SELECT *, i * (r / (r * 3 - 1)) AS x FROM e)
SELECT idx, i AS seq, {select_sql([('x', 'x'), ('y', '-(c0 + c1 * x + c2 * x * x + c3 * x * x * x)')], 7)} FROM g""",
)
def lane_samples(spark, sf):
    lanes = poses(spark, sf).selectExpr(
        "idx", "v_north / 3.7e0 AS c0", "v_east / 97 AS c1", "v_up / 1000 AS c2", "rot_x / 9973 AS c3", "idx % 5 AS view_range"
    )
    d = filters.sample_lanes(lanes)
    return d.select("idx", F.col("seq").cast("bigint").alias("seq"), *cols([("x", F.col("x")), ("y", F.col("y"))], 7))


def _ramp_channel(off: float, h: str) -> str:
    k = f"(({off}e0 + 6 * {h}) - 6 * floor(({off}e0 + 6 * {h}) / 6))"
    return f"(1 - greatest(0e0, least(1e0, {k}, 4 - {k})))"


@query(
    "intensity_colours",
    f"""WITH {POINTS}, d AS (SELECT point_id, sweep, intensity / 100 AS s FROM points)
SELECT point_id, sweep, {select_sql([(f'fast_{c}', '255 * ' + _ramp_channel(o, '(s * 0.4e0)')) for c, o in zip('rgb', (5, 3, 1))], 3)},
 {select_sql([(f'ramp_{c}', '255 * s * ' + _ramp_channel(o, '(1 - s)')) for c, o in zip('rgb', (5, 3, 1))], 3)} FROM d""",
)
def intensity_colours(spark, sf):
    p = points(spark, sf)
    fast, ramp = camera.heat_ramp(F.col("intensity"), 0.0, 100.0), camera.light_ramp(F.col("intensity"), 0.0, 100.0)
    return p.select(
        "point_id", "sweep", *cols(zip(("fast_r", "fast_g", "fast_b"), fast), 3), *cols(zip(("ramp_r", "ramp_g", "ramp_b"), ramp), 3)
    )


HALVES = ["(event_id * 2654435761 + 97) % 4294967296 AS hi", "(event_id * 1664525 * 4099 + 1013904223) % 4294967296 AS lo"]
BYTES_SQL = ", ".join(f"(hi >> {24 - 8 * i}) & 255 AS b{i}" for i in range(4)) + ", " + ", ".join(f"(lo >> {24 - 8 * i}) & 255 AS b{i + 4}" for i in range(4))
PAYLOAD = "unhex(concat(lpad(hex(hi), 8, '0'), lpad(hex(lo), 8, '0')))"


def _int(expr, name):
    return f"CAST({expr} AS INTEGER) AS {name}"


@query(
    "vision_objects",
    f"""WITH h AS (SELECT event_id, {', '.join(HALVES)} FROM events), d AS (SELECT event_id, {BYTES_SQL} FROM h),
e AS (SELECT *, (b4 & 3) * 256 + b3 AS py, (b6 & 15) * 256 + b5 AS vx FROM d)
SELECT event_id, {_int('b0', 'obj_id')}, ((b2 & 15) * 256 + b1) * 0.0625e0 AS pos_x, (CASE WHEN py > 511 THEN py - 1024 ELSE py END) * 0.0625e0 AS pos_y,
 (CASE WHEN vx > 2047 THEN vx - 4096 ELSE vx END) * 0.0625e0 AS rel_vel_x, {_int('(b6 // 16) % 8', 'obj_type')}, {_int('b7 % 8', 'status')}, {_int('(b7 // 8) % 2', 'braking')},
 {_int('(b4 // 32) % 4', 'location')}, {_int('(b4 // 4) % 8', 'blinker')}, {_int('b7 // 64', 'valid')}, b0 * 0.05e0 AS length, b1 * 0.05e0 AS width, {_int('b2', 'age')}, {_int('b3 % 4', 'lane')},
 (CASE WHEN b4 > 127 THEN b4 - 256 ELSE b4 END) * 0.03e0 AS acceleration_x FROM e""",
)
def vision_objects(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_id", *HALVES).selectExpr("event_id", f"{PAYLOAD} AS data")
    data = F.col("data")
    return d.select("event_id", *[c.alias(n) for n, c in can.decode_object(data, data, data).items()])


@query(
    "vision_lanes",
    f"""WITH h AS (SELECT event_id, {', '.join(HALVES)} FROM events), d AS (SELECT event_id, {BYTES_SQL} FROM h)
SELECT event_id, (CASE WHEN b2 > 127 THEN b2 * 256 + b1 - 65536 ELSE b2 * 256 + b1 END) / 256e0 AS c0, (b1 * 256 + b0 - 32767) / 1024e0 AS c1,
 (b4 * 256 + b3 - 32767) / 1024000e0 AS c2, (b6 * 256 + b5 - 32767) / 268435456e0 AS c3, {_int('b0 % 16', 'lane_type')}, {_int('(b0 // 16) % 4', 'quality')}, {_int('b0 // 64', 'model_degree')},
 {_int('b3 // 128', 'view_range_available')}, ((b3 % 128) * 256 + b2) / 256e0 AS view_range, (b1 * 256 + b0 - 32767) / 256e0 AS position, ((b3 % 128) * 256 + b2) / 256e0 AS distance, {_int('b3 // 128', 'is_valid')} FROM d""",
)
def vision_lanes(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_id", *HALVES).selectExpr("event_id", f"{PAYLOAD} AS data")
    data = F.col("data")
    fields = {**can.decode_lane(data, data), **can.decode_reference_point(data)}
    return d.select("event_id", *[c.alias(n) for n, c in fields.items()])


IMAGE_NAME = "'route/' || event_type || '/cam_' || lpad(CAST(event_id % 1000 AS {S}), 4, '0') || '.png'"


@query(
    "image_keys",
    f"""WITH d AS (SELECT event_id, {IMAGE_NAME.format(S='VARCHAR')} AS image FROM events)
SELECT event_id, regexp_replace(image, '_[0-9]+[.]png$', '') AS prefix, event_id % 1000 AS number,
 'route/' || split_part(image, '/', 2) || '/cam_' || lpad(CAST(event_id % 1000 + 5 AS VARCHAR), 4, '0') || '.png' AS later,
 split_part(image, '/', 2) || '/' || split_part(image, '/', 3) AS short FROM d""",
)
def image_keys(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_id", f"{IMAGE_NAME.format(S='string')} AS image")
    image = F.col("image")
    return d.select(
        "event_id",
        text.image_prefix(image).alias("prefix"),
        text.image_number(image).alias("number"),
        text.next_image(image, 5).alias("later"),
        text.last_path_parts(image, 2).alias("short"),
    )


@query(
    "local_map_pose",
    f"""WITH {POSES}, d AS (SELECT idx, v_east * 10 AS x, v_north * 10 AS y, 180 + 14.869e0 - azimuth AS yaw FROM poses),
e AS (SELECT idx, x, y, CASE WHEN yaw > 180 THEN yaw - 360 WHEN yaw < -180 THEN yaw + 360 ELSE yaw END AS yaw, sqrt(x * x + y * y) AS r, atan2(-y, x) + radians(14.869e0) AS th FROM d)
SELECT idx, {select_sql([('yaw', 'yaw'), ('map_x', '-r * cos(th) + 12.3e0 + 0.34e0 * cos(radians(yaw) + pi())'), ('map_y', '-r * sin(th) - 13.07e0 + 0.34e0 * sin(radians(yaw) + pi())')])} FROM e""",
)
def local_map_pose(spark, sf):
    d = poses(spark, sf).selectExpr("idx", "v_east * 10 AS x", "v_north * 10 AS y", "azimuth")
    d = d.withColumn("yaw", text.map_yaw(F.col("azimuth"), 14.869))
    pose = text.local_map_pose(F.col("x"), F.col("y"), F.col("yaw"), 14.869, (12.3, -13.07), 0.34)
    return d.select("idx", *cols([("yaw", F.col("yaw")), ("map_x", pose[0]), ("map_y", pose[1])]))


@query(
    "lane_centre_codes",
    """WITH d AS (SELECT vec_id, unnest(range(0, 32)) AS i, embedding FROM embeddings)
SELECT vec_id, i AS seq, CAST(floor(((CAST(embedding[i + 1] AS DOUBLE) * 10 + CAST(embedding[i + 33] AS DOUBLE) * 10) / 2 + 327.68e0) / 0.01e0) AS BIGINT) AS code FROM d""",
)
def lane_centre_codes(spark, sf):
    d = table(spark, sf, "embeddings")

    def side(start):
        return F.transform(F.slice("embedding", start, 32), lambda v: v.cast("double") * 10)

    codes = F.transform(text.centre_line(side(1), side(33)), text.lane_code)
    return d.select("vec_id", F.posexplode(codes).alias("seq", "code")).withColumn("seq", F.col("seq").cast("bigint"))


@query(
    "lane_label_positions",
    f"""WITH {POSES}, {FIRST_SQL}, d AS (SELECT p.run_id, idx, ((idx * 37) % 1280 - 640e0) / 1200e0 AS a, (500 + (idx * 53) % 460 - 480e0) / 1190e0 AS b, lat, lon, height, lat_0, lon_0, height_0, {BASE_SQL}
 FROM poses p JOIN first f ON p.run_id = f.run_id),
e AS (SELECT *, {', '.join(f'{c} AS h{i}' for i, c in enumerate(ENU0))}, 1.105e0 / b AS fx, -a * (1.105e0 / b) AS fy, -1.105e0 AS fz FROM d),
g AS (SELECT *, {', '.join(dot_sql([f'm{k}{i}' for k in range(3)], ['fx', 'fy', 'fz']) + f' AS w{i}' for i in range(3))} FROM e)
SELECT run_id, idx, {select_sql([('east', 'h0 + w0'), ('north', 'h1 + w1'), ('up', 'h2 + w2')], 3)} FROM g""",
)
def lane_label_positions(spark, sf):
    """Labelled lane pixels to the road, to the vehicle, to the first pose's frame, to coordinates and back to ENU."""
    p = poses(spark, sf)
    labels = p.selectExpr("run_id", "idx", "(idx * 37) % 1280 AS u", "500 + (idx * 53) % 460 AS v")
    d = filters.lane_labels_to_wgs84(labels, p, ["run_id"], "idx", ["t_us", "idx"], FOCAL, CENTRE, 1.105)
    ref = [F.col(c) for c in ("lat_0", "lon_0", "height_0")]
    back = geodesy.wgs84_to_enu(F.col("label_lat"), F.col("label_lon"), F.col("label_height"), ref)
    return d.select("run_id", "idx", *cols(zip(("east", "north", "up"), back), 3))


# --- filters --------------------------------------------------------------------------------------


@query(
    "point_presets",
    f"""WITH {POINTS}, d AS (SELECT point_id, sweep, x - 25 AS x, y - 50 AS y, z - 5 AS z, intensity FROM points)
SELECT point_id, sweep, {select_sql([('x', 'x'), ('y', 'y'), ('z', 'z')])} FROM d
WHERE intensity > 30 AND x > 0 AND sqrt(x * x + y * y + z * z) > 3 AND y > -30 AND y < 30 AND z > -3 AND z < -1""",
)
def point_presets(spark, sf):
    d = points(spark, sf).selectExpr("point_id", "sweep", "x - 25 AS x", "y - 50 AS y", "z - 5 AS z", "intensity")
    d = filters.apply_presets(d, ["default", "forward", "roof", "no-trees"])
    return d.select("point_id", "sweep", *cols([(c, F.col(c)) for c in "xyz"]))


@query(
    "radar_plausible",
    f"""WITH {POINTS} SELECT point_id, sweep, x FROM points WHERE z - 3 > 0 AND x - 40 > -20""",
)
def radar_plausible(spark, sf):
    d = points(spark, sf).withColumns({"rcs": F.col("z") - 3, "rel_spd": F.col("x") - 40})
    return d.where(filters.plausible_radar(0.0)).select("point_id", "sweep", "x")


@query("range_pass", f"WITH {POINTS} SELECT point_id, sweep, y FROM points WHERE y BETWEEN 20 AND 40 AND z BETWEEN 2 AND 8")
def range_pass(spark, sf):
    return points(spark, sf).where(filters.pass_through({"y": (20, 40), "z": (2, 8)})).select("point_id", "sweep", "y")
