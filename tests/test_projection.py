"""Points in camera images against a plain chain of matrices."""

import numpy as np
import pytest

from wayline.operators import projection

RNG = np.random.default_rng(7)
LIDAR = np.array([[0.9998, -0.02, 0.0, 1.6], [0.02, 0.9998, 0.0, -0.2], [0.0, 0.0, 1.0, 1.9], [0.0, 0.0, 0.0, 1.0]])
LIDAR[:2, :2] = [[np.cos(0.02), -np.sin(0.02)], [np.sin(0.02), np.cos(0.02)]]
LENSES = {0: [-0.25, 0.08, 0.001, -0.0005, 0.01], 1: [0.0, 0.0, 0.0, 0.0, 0.0], 2: [-0.3, 0.0, 0.0, 0.0, 0.0]}
AXES = np.array([[0.0, -1.0, 0.0], [0.0, 0.0, -1.0], [1.0, 0.0, 0.0]])


def turned(angles):
    a, b, c = angles
    z = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    x = np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
    y = np.array([[np.cos(c), 0, np.sin(c)], [0, 1, 0], [-np.sin(c), 0, np.cos(c)]])
    return z @ x @ y


def pixel(p, pose, turn, camera):
    inv = np.linalg.inv(LIDAR)
    q = inv[:3, :3] @ (turn.T @ (p - pose)) + inv[:3, 3] + np.array([0.1, -0.3, 0.2])
    x, y, z = turned((0.0, 0.0, 0.1 * camera)) @ AXES @ q + np.array([0.0, 0.01, 0.02])
    if z <= 0 or x * x + y * y + z * z <= 3:
        return None
    a, b = x / z, y / z
    k1, k2, p1, p2, k3 = LENSES[camera]
    r2 = a * a + b * b
    radial = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3
    u = 1200 * (a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)) + 640
    v = 1190 * (b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b) + 480
    u, v = round(u), round(v)
    return (u, v) if 2 < u < 1277 and 2 < v < 957 else None


@pytest.mark.parametrize("window", [None, 40])
def test_pixels_match_the_plain_chain(spark, window):
    points = [("r" if i % 3 else "q", i, int(RNG.integers(200)), *map(float, RNG.uniform(-60, 60, 3) * [1, 1, 0.2] + [1000.0, -500.0, 10.0])) for i in range(1500)]
    points += [("r", 9000, 5, None, 0.0, 0.0), ("r", 9001, 5, float("nan"), 0.0, 0.0)]
    frames = []
    for f in range(24):
        turn = turned(RNG.uniform(-0.4, 0.4, 3) + [RNG.uniform(0, 6.3), 0, 0])
        frames.append(("r" if f % 2 else "q", f, f % 3, int(RNG.integers(200)), *map(float, RNG.uniform(-40, 40, 3) * [1, 1, 0.1] + [1000.0, -500.0, 10.0]), *map(float, turn.ravel())))
    rig = []
    for c, lens in LENSES.items():
        extrinsic = np.eye(4)
        extrinsic[:3, 3] = [0.0, 0.01, 0.02]
        matrix = [1200.0, 0.0, 640.0, 0.0, 1190.0, 480.0, 0.0, 0.0, 1.0]
        rig.append((c, LIDAR.ravel().tolist(), [0.1, -0.3, 0.2], turned((0.0, 0.0, 0.1 * c)).ravel().tolist(), extrinsic.ravel().tolist(), matrix, lens, 1280, 960))
    lists = "lidar_to_vehicle array<double>, displacement array<double>, rotation array<double>, extrinsic array<double>, matrix array<double>, distort array<double>"
    got = projection.project_map(
        spark.createDataFrame(points, "run string, id bigint, t bigint, x double, y double, z double"),
        spark.createDataFrame(frames, "run string, frame int, camera int, t bigint, px double, py double, pz double, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3))),
        spark.createDataFrame(rig, f"camera int, {lists}, width int, height int"),
        ["run"], "id", "frame", time="t" if window else None, window=window, finest=5.0,
    )
    got = {(r.run, r.frame, r.id): (r.u, r.v) for r in got.collect()}
    want = {}
    for run, f, c, t, px, py, pz, *turn in frames:
        for prun, i, pt, *p in points[:-2]:
            if prun == run and (window is None or abs(pt - t) < window):
                seen = pixel(np.array(p), np.array([px, py, pz]), np.reshape(turn, (3, 3)), c)
                if seen:
                    want[run, f, i] = seen
    assert got == want and len(want) > 100


def test_view_radius_covers_what_can_show_up():
    for lens in ([0, 0, 0, 0, 0], [-0.25, 0.08, 0.001, -0.0005, 0.01], [-0.3, 0, 0, 0, 0], [0.1, 0, 0.01, 0.01, 0]):
        limit = projection.view_radius((1200.0, 1190.0), (640.0, 480.0), lens, (1280, 960))
        r = np.linspace(0, 30, 3001)
        for angle in np.linspace(0, 6.28, 40):
            a, b = r * np.cos(angle), r * np.sin(angle)
            k1, k2, p1, p2, k3 = lens
            radial = 1 + k1 * r**2 + k2 * r**4 + k3 * r**6
            u = 1200 * (a * radial + 2 * p1 * a * b + p2 * (r**2 + 2 * a * a)) + 640
            v = 1190 * (b * radial + p1 * (r**2 + 2 * b * b) + 2 * p2 * a * b) + 480
            inside = (u >= 0) & (u <= 1280) & (v >= 0) & (v <= 960)
            assert not inside[r > limit].any()
    assert projection.view_radius((1.0, 1.0), (0.5, 0.5), (0, 0, 0.1, 0, 0), (1, 1)) == float("inf")
