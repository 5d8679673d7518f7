"""Known answers of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from wayline.functions import boxes as bx
from wayline.functions import camera, can, geodesy, rotation, text

REF = (37.506827757, -122.340466199, 78.721976453)
POINT = (37.506763761, -122.339483472, 79.808823725)
EAST_NORTH_UP = (86.89131850930292, -7.102369271144839, 1.086252189612837)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lits(values):
    return [F.lit(float(v)) for v in values]


def test_enu_exact_and_series(spark):
    exact = geodesy.wgs84_to_enu(*lits(POINT), lits(REF))
    series = geodesy.wgs84_to_enu_series(*lits(POINT), lits(REF))
    row = one(spark, **{f"e{i}": c for i, c in enumerate(exact)}, **{f"s{i}": c for i, c in enumerate(series)})
    for i, want in enumerate(EAST_NORTH_UP):
        assert row[f"s{i}"] == pytest.approx(want, abs=1e-9)
        assert row[f"e{i}"] == pytest.approx(want, abs=1e-5)


def test_enu_round_trip(spark):
    enu = geodesy.wgs84_to_enu(*lits(POINT), lits(REF))
    d = spark.range(1).select(*[c.alias(n) for n, c in zip("enu", enu)])
    row = geodesy.with_enu_to_wgs84(d, [F.col(n) for n in "enu"], lits(REF)).first()
    assert (row.lat, row.lon) == pytest.approx(POINT[:2], abs=1e-9)
    assert row.height == pytest.approx(POINT[2], abs=1e-6)


def test_gps_time(spark):
    row = one(spark, t=geodesy.gps_to_utc_us(F.lit(1786), F.lit(400000.0)))
    assert row.t == 1396537584000000


def test_rotations_are_orthonormal_and_match_quaternions(spark):
    angles = lits((12.0, -7.0, 211.0))
    m = rotation.attitude(*angles)
    back = rotation.quat_matrix(rotation.attitude_quat(*angles))
    names = {f"m{i}{j}": rotation.as_column(m[i][j]) for i in range(3) for j in range(3)}
    names |= {f"q{i}{j}": rotation.as_column(back[j][i]) for i in range(3) for j in range(3)}
    row = one(spark, **names)
    for i in range(3):
        for j in range(3):
            assert row[f"m{i}{j}"] == pytest.approx(row[f"q{i}{j}"], abs=1e-12)
            dot = sum(row[f"m{i}{k}"] * row[f"m{j}{k}"] for k in range(3))
            assert dot == pytest.approx(float(i == j), abs=1e-12)


def test_euler_matrix_and_back(spark):
    # static y, x, z turns of 1, 2, 3 radians: the first row sums to this known value
    m = rotation.euler_matrix(lits((1, 2, 3)), (1, 0, 2))
    assert one(spark, s=rotation.as_column(m[0][0] + m[0][1] + m[0][2])).s == pytest.approx(-1.34786452, abs=1e-8)
    small = rotation.euler_matrix(lits((0.1, -0.2, 0.3)), (0, 1, 2))
    row = one(spark, **{f"a{i}": a for i, a in enumerate(rotation.euler_angles(small))})
    assert [row.a0, row.a1, row.a2] == pytest.approx([0.1, -0.2, 0.3], abs=1e-12)


@pytest.mark.parametrize("f", [0.0, 0.25, 0.5, 1.0])
def test_slerp_goes_evenly(spark, f):
    half = math.pi / 6
    w1, w2 = rotation.slerp_weights(F.lit(math.cos(half)), F.lit(f))
    row = one(spark, a=w1, b=w2)
    w, z = row.a + row.b * math.cos(half), row.b * math.sin(half)
    assert math.atan2(z, w) == pytest.approx(half * f, abs=1e-12)


def test_rigid_inverse(spark):
    m, t, p = rotation.euler_matrix(lits((0.3, 0.2, 0.1)), (0, 1, 2)), (1.0, 2.0, 3.0), lits((4, 5, 6))
    back = rotation.rigid_inverse(m, t, rotation.rigid(m, t, p))
    row = one(spark, **{n: rotation.as_column(c) for n, c in zip("xyz", back)})
    assert [row.x, row.y, row.z] == pytest.approx([4, 5, 6])


def test_box_measures(spark):
    a, b = lits((0, 0, 10, 10)), lits((5, 0, 15, 10))
    row = one(spark, i=bx.intersection(a, b), c=bx.cover(a, b), o=bx.iou(a, b), d=bx.centre_distance(a, b))
    assert (row.i, row.c, row.o, row.d) == pytest.approx((50, 0.5, 1 / 3, 1.0))
    far = one(spark, i=bx.intersection(a, lits((10, 0, 20, 10))))
    assert far.i == 0


def test_aspect_and_resize(spark):
    b = lits((0, 0, 10, 10))
    wide = bx.force_aspect(b, 2.0)
    grown = bx.resize(b, 2.0)
    row = one(spark, a=wide[0], b=wide[2], c=grown[1], d=grown[3])
    assert (row.a, row.b, row.c, row.d) == (-5, 15, -5, 15)


def test_can_bits(spark):
    data = F.unhex(F.lit("07FF0F03030F7F81"))
    got = one(spark, **can.decode_object(data, data, data))
    assert got.obj_id == 7
    assert got.pos_x == 0xFFF * 0.0625
    assert got.pos_y == (0x303 - 1024) * 0.0625
    assert got.rel_vel_x == (0xF0F - 4096) * 0.0625
    assert got.obj_type == 7 and got.status == 1 and got.valid == 2
    assert got.acceleration_x == 3 * 0.03


def test_image_names(spark):
    n = F.lit("a/b_c_000998.jpeg")
    row = one(spark, p=text.image_prefix(n), i=text.image_number(n), s=text.next_image(n, 5), k=text.last_path_parts(n, 1))
    assert (row.p, row.i, row.s, row.k) == ("a/b_c", 998, "a/b_c_001003.jpeg", "b_c_000998.jpeg")


def test_projection_without_distortion(spark):
    d = spark.createDataFrame([(1.0, 2.0, 10.0), (0.0, 0.0, -1.0)], "x double, y double, z double")
    got = camera.with_pixels(d, [F.col(c) for c in "xyz"], (100.0, 100.0), (50.0, 60.0), (0, 0, 0, 0, 0)).collect()
    assert [(r.u, r.v) for r in got] == [(60.0, 80.0)]


def test_ray_meets_plane(spark):
    hit = camera.ray_on_plane((0, 0, 0), lits((0.5, 1, 1)), (0, 1, 0), (0, 2, 0))
    row = one(spark, **{n: c for n, c in zip("xyz", hit)})
    assert (row.x, row.y, row.z) == (1, 2, 2)
