"""Rotations and rigid transforms as column expressions.

A vector is a list of three columns, a matrix a list of three rows. Entries may
be Python numbers; zero and one terms then vanish from the expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Entry = Column | float
Vector = Sequence[Entry]
Matrix = Sequence[Sequence[Entry]]


def _is(value, number) -> bool:
    return isinstance(value, (int, float)) and value == number


def _times(a: Entry, b: Entry) -> Entry:
    if _is(a, 0) or _is(b, 0):
        return 0
    if _is(a, 1):
        return b
    return a if _is(b, 1) else a * b


def _plus(a: Entry, b: Entry) -> Entry:
    if _is(a, 0):
        return b
    return a if _is(b, 0) else a + b


def dot(a: Vector, b: Vector) -> Entry:
    total: Entry = 0
    for x, y in zip(a, b):
        total = _plus(total, _times(x, y))
    return total


def as_column(value: Entry) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def cross(a: Vector, b: Vector) -> list[Entry]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(as_column(dot(a, a)))


def transpose(m: Matrix) -> list[list[Entry]]:
    return [list(col) for col in zip(*m)]


def mat_vec(m: Matrix, v: Vector) -> list[Entry]:
    return [dot(row, v) for row in m]


def mat_mul(a: Matrix, b: Matrix) -> list[list[Entry]]:
    cols = transpose(b)
    return [[dot(row, col) for col in cols] for row in a]


def turn(axis: int, angle: Column) -> list[list[Entry]]:
    """Right-handed turn about axis 0, 1 or 2."""
    c, s = F.cos(angle), F.sin(angle)
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m: list[list[Entry]] = [[1 if r == k else 0 for k in range(3)] for r in range(3)]
    m[i][i], m[i][j], m[j][i], m[j][j] = c, -s, s, c
    return m


def attitude(rot_x: Column, rot_y: Column, azimuth: Column) -> list[list[Entry]]:
    """World (east, north, up) to vehicle rotation; angles in degrees, azimuth clockwise."""
    yaw, roll, pitch = -F.radians(azimuth), F.radians(rot_x), F.radians(rot_y)
    return transpose(mat_mul(mat_mul(turn(2, yaw), turn(0, roll)), turn(1, pitch)))


def euler_matrix(angles: Sequence[Column], axes: Sequence[int]) -> list[list[Entry]]:
    """Static-frame Euler turns, applied in the order given."""
    m = turn(axes[0], angles[0])
    for axis, angle in zip(axes[1:], angles[1:]):
        m = mat_mul(turn(axis, angle), m)
    return m


def euler_angles(m: Matrix) -> list[Column]:
    """Static x, y, z angles of a rotation matrix (away from the pole)."""
    flat = F.sqrt(as_column(m[0][0] * m[0][0] + m[1][0] * m[1][0]))
    return [F.atan2(as_column(m[2][1]), as_column(m[2][2])), F.atan2(-m[2][0], flat), F.atan2(as_column(m[1][0]), as_column(m[0][0]))]


def rigid(m: Matrix, t: Vector, p: Vector) -> list[Entry]:
    """R p + t."""
    return [_plus(x, s) for x, s in zip(mat_vec(m, p), t)]


def rigid_inverse(m: Matrix, t: Vector, p: Vector) -> list[Entry]:
    """Undo :func:`rigid`: R' (p - t)."""
    return mat_vec(transpose(m), [a - b for a, b in zip(p, t)])


def about_point(m: Matrix, centre: Vector, shift: Vector, p: Vector) -> list[Entry]:
    """Turn about a centre, then shift."""
    turned = mat_vec(m, [a - c for a, c in zip(p, centre)])
    return [a + c + s for a, c, s in zip(turned, centre, shift)]


# quaternions: [w, x, y, z]


def quat_mul(a: Vector, b: Vector) -> list[Entry]:
    aw, av, bw, bv = a[0], a[1:], b[0], b[1:]
    c = [
        _plus(_times(av[(i + 1) % 3], bv[(i + 2) % 3]), _times(-1, _times(av[(i + 2) % 3], bv[(i + 1) % 3]))) for i in range(3)
    ]
    w = _plus(_times(aw, bw), _times(-1, dot(av, bv)))
    return [w, *[_plus(_plus(_times(aw, bv[i]), _times(bw, av[i])), c[i]) for i in range(3)]]


def axis_quat(axis: int, angle: Column) -> list[Entry]:
    out: list[Entry] = [F.cos(angle / 2), 0, 0, 0]
    out[axis + 1] = F.sin(angle / 2)
    return out


def attitude_quat(rot_x: Column, rot_y: Column, azimuth: Column) -> list[Entry]:
    """Vehicle to world rotation of :func:`attitude` (its inverse) as a quaternion."""
    yaw, roll, pitch = -F.radians(azimuth), F.radians(rot_x), F.radians(rot_y)
    return quat_mul(quat_mul(axis_quat(2, yaw), axis_quat(0, roll)), axis_quat(1, pitch))


def slerp_weights(cosine: Column, f: Column) -> tuple[Column, Column]:
    """Weights of both ends of the shorter arc; ``cosine`` is the dot product of the ends."""
    c = F.least(F.abs(cosine), F.lit(1.0))
    angle = F.acos(c)
    s = F.sin(angle)
    flat = s < 1e-9
    first = F.when(flat, 1 - f).otherwise(F.try_divide(F.sin((1 - f) * angle), s))
    second = F.when(flat, f).otherwise(F.try_divide(F.sin(f * angle), s))
    return first, F.when(cosine < 0, -second).otherwise(second)


def quat_matrix(q: Vector) -> list[list[Entry]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
