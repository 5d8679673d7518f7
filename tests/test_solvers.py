"""Solvers, fits and lane curves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import rotation
from wayline.operators import lanes, registration, smoothing, trace

XYZ = ["x", "y", "z"]


def natural_spline(t, v, at):
    """Natural cubic spline through (t, v[:, k]) at the times ``at``, by a dense solve."""
    n = len(t)
    if n == 1:
        return np.repeat(v[:1], len(at), axis=0)
    h, m = np.diff(t), np.zeros_like(v)
    if n > 2:
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        m[1:-1] = np.linalg.solve(a, 6 * np.diff(np.diff(v, axis=0) / h[:, None], axis=0))
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b, w = (t[k + 1] - at)[:, None], (at - t[k])[:, None], h[k][:, None]
    return m[k] * a**3 / (6 * w) + m[k + 1] * b**3 / (6 * w) + (v[k] / w - m[k] * w / 6) * a + (v[k + 1] / w - m[k + 1] * w / 6) * b


def test_natural_spline_is_smooth_and_passes_through():
    t = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    v = np.column_stack([np.sin(t), t * 2 + 1])
    assert np.allclose(natural_spline(t, v, t), v)
    at = np.linspace(0, 7, 701)
    out = natural_spline(t, v, at)
    assert np.allclose(out[:, 1], at * 2 + 1)
    second = np.diff(out[:, 0], 2)
    assert abs(second[0]) < 1e-5 and np.abs(np.diff(second)).max() < 1e-4


@pytest.mark.parametrize("block_rows", [2, 50, 4096])
def test_resampling_in_blocks_equals_the_whole_lane(spark, block_rows):
    rng = random.Random(2)
    lanes_of = {("r", lane): sorted(rng.sample(range(0, 4_000_000), n)) for lane, n in enumerate((400, 1, 2, 3, 4, 51))}
    rows = [(run, lane, ti, rng.uniform(-1, 1), float(i), rng.gauss(0, 1)) for (run, lane), t in lanes_of.items() for i, ti in enumerate(t)]
    d = spark.createDataFrame(rows, "run string, lane int, t bigint, x double, y double, z double")
    got = lanes.resample_lanes(d, ["run", "lane"], "t", 500_000, 10_000, block_rows=block_rows).collect()
    for (run, lane), t in lanes_of.items():
        mine = sorted((r.seq, r.t, r.x, r.y, r.z) for r in got if (r.run, r.lane) == (run, lane))
        at = np.arange(t[0], t[-1] + 1, 10_000)
        values = np.array([r[3:] for r in rows if r[:2] == (run, lane)])
        assert [g[1] for g in mine] == at.tolist()
        assert np.allclose(np.array([g[2:] for g in mine]), natural_spline(np.array(t, float) / 1e6, values, at / 1e6), rtol=0, atol=1e-9)


@pytest.mark.parametrize("block_rows, stiffness", [(2, 3.0), (50, 1e4), (4096, 1e4), (6, 0.0)])
def test_fixed_lanes_are_the_dense_solution(spark, block_rows, stiffness):
    rng = np.random.default_rng(0)
    sizes = {lane: n for lane, n in enumerate((700, 1, 2, 3, 4, 7))}
    rows = [("r", lane, i, *map(float, np.array([0.01 * i, 0.1, 0.0]) + rng.normal(0, 0.3, 3))) for lane, n in sizes.items() for i in range(n)]
    measured = [("r", k, r[3] + 0.05, r[4], r[5] - 0.02) for k, r in enumerate(rows) if k % 3 == 0]
    d = spark.createDataFrame(rows, "run string, lane int, seq bigint, x double, y double, z double")
    m = spark.createDataFrame(measured, "run string, id bigint, x double, y double, z double")
    got = lanes.fix_lanes(d, m, ["run"], ["run", "lane"], "seq", "id", 97, limit=0.25, stiffness=(stiffness,) * 3, block_rows=block_rows).collect()
    at = np.array([r[2:] for r in measured])
    for lane, n in sizes.items():
        mine = sorted((r for r in got if r.lane == lane), key=lambda r: r.seq)
        own = np.array([[r.x, r.y, r.z] for r in mine])
        dist = np.linalg.norm(own[:, None] - at[None], axis=2)
        hit = dist.min(axis=1) < 0.25
        assert [r.snapped for r in mine] == hit.tolist()
        seen, weight = np.where(hit[:, None], at[dist.argmin(axis=1)], own), np.where(hit, 2.0, 1.0)
        second = np.diff(np.eye(n), 2, axis=0) if n > 2 else np.zeros((0, n))
        want = np.linalg.solve(np.diag(weight) + stiffness * second.T @ second, weight[:, None] * seen)
        assert np.allclose([[r.x_fixed, r.y_fixed, r.z_fixed] for r in mine], want, rtol=0, atol=1e-9)


@pytest.mark.parametrize("keep", [0.0, 0.01, 0.3, 0.99, 0.9999])
def test_running_mix_for_any_memory(spark, keep, monkeypatch):
    monkeypatch.setattr(lanes, "DECAY_ROWS", 8)
    rng = np.random.default_rng(3)
    sizes = {"a": 700, "b": 1, "c": 9}
    rows = [(k, i, float(v)) for k, n in sizes.items() for i, v in enumerate(rng.normal(0, 10, n))]
    d = spark.createDataFrame(rows, "k string, i bigint, v double")
    got = {(r.k, r.i): r.v_smooth for r in lanes.smooth_normals(d, ["k"], ["i"], ["v"], 41, keep=keep).collect()}
    assert len(got) == len(rows)
    for k, i, v in rows:
        mix = v if i == 0 else keep * mix + (1 - keep) * v
        assert got[k, i] == pytest.approx(mix, rel=1e-9, abs=1e-9)


def plain_smoother(pos: np.ndarray, scan: np.ndarray) -> tuple[np.ndarray, ...]:
    """Filtered and smoothed positions and their variances, (n, 3) each.

    State per axis: position and velocity, one step a row. The INS position is
    seen at every row, the scan-matched one (pos + increment) where it is not nan.
    """
    n = len(pos)
    step = np.abs(np.diff(pos, axis=0, prepend=pos[:1]))
    m = np.zeros((n, 3, 2))
    p = np.zeros((n, 3, 2, 2))
    pred_m, pred_p = m.copy(), p.copy()
    a = np.array([[1.0, 1.0], [0.0, 1.0]])
    m[0, :, 0] = pos[0]
    m[0, :, 1] = pos[1] - pos[0] if n > 1 else 0.0
    p[0, :, 0, 0] = smoothing.START_VAR
    p[0, :, 1, 1] = smoothing.VELOCITY_VAR
    for t in range(1, n):
        mean = m[t - 1] @ a.T
        cov = a @ p[t - 1] @ a.T
        cov[:, 0, 0] += 10 * step[t]
        cov[:, 1, 1] += step[t]
        pred_m[t], pred_p[t] = mean, cov
        for z, var in ((pos[t], smoothing.INS_VAR), (scan[t], smoothing.SCAN_VAR)):
            if np.isnan(z).any():
                continue
            gain = cov[:, :, 0] / (cov[:, 0, 0] + var)[:, None]
            mean = mean + gain * (z - mean[:, 0])[:, None]
            cov = cov - gain[:, :, None] * cov[:, None, 0, :]
        m[t], p[t] = mean, cov
    sm, sp = m.copy(), p.copy()
    for t in range(n - 2, -1, -1):
        gain = p[t] @ a.T @ np.linalg.pinv(pred_p[t + 1])
        sm[t] = m[t] + np.einsum("kij,kj->ki", gain, sm[t + 1] - pred_m[t + 1])
        sp[t] = p[t] + gain @ (sp[t + 1] - pred_p[t + 1]) @ gain.transpose(0, 2, 1)
    return m[:, :, 0], p[:, :, 0, 0], sm[:, :, 0], sp[:, :, 0, 0]


def drive(rng, n):
    """A car that moves, stands for half of the way and moves again; every fifth row has a scan match."""
    pos = np.cumsum(rng.normal(0.3, 0.4, (n, 3)), axis=0)
    pos[n // 4 : 3 * n // 4] = pos[n // 4]
    inc = np.full((n, 3), np.nan)
    inc[::5] = rng.normal(0, 0.1, (len(inc[::5]), 3))
    return pos, inc


@pytest.mark.parametrize("block_rows", [50, 333, 8192])
def test_smoother_is_the_same_for_all_blocks(spark, block_rows):
    rng = np.random.default_rng(2)
    runs = {"a": drive(rng, 900), "b": drive(rng, 101), "one": drive(rng, 1), "two": drive(rng, 2)}
    rows = [(r, i, *map(float, p), *[None if np.isnan(v) else float(v) for v in inc]) for r, (ps, incs) in runs.items() for i, (p, inc) in enumerate(zip(ps, incs))]
    d = spark.createDataFrame(rows, "run string, t bigint, x double, y double, z double, ix double, iy double, iz double")
    got = smoothing.smooth_trajectory(d, ["run"], ["t"], 100, block_rows=block_rows).toPandas()
    assert len(got) == len(rows)
    for r, (pos, inc) in runs.items():
        g = got[got["run"] == r].sort_values("t")
        f, vf, sm, vs = plain_smoother(pos, pos + inc)
        assert np.allclose(g[["x_f", "y_f", "z_f"]], f, rtol=0, atol=1e-9) and np.allclose(g[["x_s", "y_s", "z_s"]], sm, rtol=0, atol=1e-9)
        assert np.allclose(g[["var_f_x", "var_f_y", "var_f_z"]], vf, rtol=0, atol=1e-9) and np.allclose(g[["var_s_x", "var_s_y", "var_s_z"]], vs, rtol=0, atol=1e-9)
        assert (g["var_s_x"] <= g["var_f_x"] + 1e-9).all()


def plain_bias_corrected(gps: np.ndarray, velocity: np.ndarray, dt: float, gps_var: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Positions x and biases b of one axis that minimise odometry, bias-drift and GPS residuals, \\|b\\| <= 2.

    The normal equations are block tridiagonal in (x_t, b_t). Biases beyond the
    limit are fixed there and freed again when their gradient points inward.
    """
    n = len(gps)
    wo, wb, wg = 1 / smoothing.ODOMETRY_VAR, 1 / smoothing.BIAS_VAR, 1 / gps_var
    diag = np.zeros((n, 2, 2))
    rhs = np.zeros((n, 2))
    diag += wg * np.array([[1.0, -1.0], [-1.0, 1.0]])
    rhs[:, 0] += wg * gps
    rhs[:, 1] -= wg * gps
    diag[1:, 0, 0] += wo
    diag[:-1, 0, 0] += wo
    rhs[1:, 0] += wo * velocity[:-1] * dt
    rhs[:-1, 0] -= wo * velocity[:-1] * dt
    diag[1:, 1, 1] += wb
    diag[:-1, 1, 1] += wb * smoothing.BIAS_DECAY**2
    off = np.array([[-wo, 0.0], [0.0, -wb * smoothing.BIAS_DECAY]])  # between t and t + 1
    fixed = np.full(n, np.nan)
    x = np.zeros((n, 2))
    for _ in range(rounds):
        held = ~np.isnan(fixed)
        d, r = diag.copy(), rhs.copy()
        left = np.tile(off, (max(n - 1, 0), 1, 1))
        if held.any():
            b = np.where(held, fixed, 0.0)
            r[:, 0] -= d[:, 0, 1] * b
            r[1:, 1] -= off[1, 1] * b[:-1]
            r[:-1, 1] -= off[1, 1] * b[1:]
            d[held, 0, 1] = d[held, 1, 0] = 0.0
            d[held, 1, 1] = 1.0
            r[held, 1] = fixed[held]
            cut = held[:-1] | held[1:]
            left[cut, 1, 1] = 0.0
        for t in range(1, n):
            f = left[t - 1] @ np.linalg.inv(d[t - 1])
            d[t] -= f @ left[t - 1]
            r[t] -= f @ r[t - 1]
        x[n - 1] = np.linalg.solve(d[n - 1], r[n - 1])
        for t in range(n - 2, -1, -1):
            x[t] = np.linalg.solve(d[t], r[t] - left[t] @ x[t + 1])
        b = x[:, 1]
        grad = diag[:, 1, 0] * x[:, 0] + diag[:, 1, 1] * b - rhs[:, 1]
        grad[1:] += off[1, 1] * b[:-1]
        grad[:-1] += off[1, 1] * b[1:]
        new = fixed.copy()
        new[~held & (b > smoothing.BIAS_LIMIT + 1e-9)] = smoothing.BIAS_LIMIT
        new[~held & (b < -smoothing.BIAS_LIMIT - 1e-9)] = -smoothing.BIAS_LIMIT
        new[held & (fixed * grad > 1e-9)] = np.nan
        if np.array_equal(np.isnan(new), np.isnan(fixed)):
            break
        fixed = new
    return x[:, 0], np.clip(x[:, 1], -smoothing.BIAS_LIMIT, smoothing.BIAS_LIMIT)


def objective(gps, vel, dt, g, x, b):
    odo = x[1:] - x[:-1] - vel[:-1] * dt
    drift = b[1:] - smoothing.BIAS_DECAY * b[:-1]
    return (odo**2).sum() / smoothing.ODOMETRY_VAR + (drift**2).sum() / smoothing.BIAS_VAR + ((x - gps - b) ** 2).sum() / g


def test_bias_correction_is_optimal_within_its_limit():
    rng = np.random.default_rng(1)
    gps, vel = np.cumsum(rng.normal(0, 3, 60)), rng.normal(0, 1, 60)
    x, b = plain_bias_corrected(gps, vel, 0.02, 0.5)
    assert np.abs(b).max() <= smoothing.BIAS_LIMIT
    base = objective(gps, vel, 0.02, 0.5, x, b)
    for _ in range(300):
        dx, db = rng.normal(0, 1e-3, 60), rng.normal(0, 1e-3, 60)
        assert objective(gps, vel, 0.02, 0.5, x + dx, np.clip(b + db, -2, 2)) >= base - 1e-9


@pytest.mark.parametrize("block_rows", [50, 333, 8192])
def test_bias_correction_is_the_same_for_all_blocks(spark, block_rows):
    rng = np.random.default_rng(6)
    runs = {r: (np.cumsum(rng.normal(0, 3, (n, 3)), axis=0), rng.normal(0, 1, (n, 3))) for r, n in (("a", 700), ("b", 51), ("one", 1), ("two", 2))}
    rows = [(r, i, *map(float, g), *map(float, v)) for r, (gs, vs) in runs.items() for i, (g, v) in enumerate(zip(gs, vs))]
    d = spark.createDataFrame(rows, "run string, t bigint, x double, y double, z double, v_east double, v_north double, v_up double")
    got = smoothing.corrected_trajectory(d, ["run"], ["t"], 100, block_rows=block_rows).toPandas()
    assert len(got) == len(rows) and got["residual"].max() < 1e-8
    limited = 0
    for r, (gps, vel) in runs.items():
        g = got[got["run"] == r].sort_values("t")
        for k, c in enumerate("xyz"):
            x, b = plain_bias_corrected(gps[:, k], vel[:, k], smoothing.STEP_S, smoothing.GPS_VAR[k]) if len(gps) > 1 else (gps[:, k], np.zeros(1))
            assert np.allclose(g[f"{c}_c"], x, rtol=0, atol=1e-9) and np.allclose(g[f"b_{c}"], b, rtol=0, atol=1e-9)
            limited += (np.abs(b) >= smoothing.BIAS_LIMIT - 1e-9).sum()
    assert limited > 100


def test_runs_of_one_block_are_corrected_in_one_round(spark, monkeypatch):
    rng = np.random.default_rng(8)
    runs = {r: (np.cumsum(rng.normal(0, 3, (60, 3)), axis=0), rng.normal(0, 1, (60, 3))) for r in range(30)}
    rows = [(r, i, *map(float, g), *map(float, v)) for r, (gs, vs) in runs.items() for i, (g, v) in enumerate(zip(gs, vs))]
    d = spark.createDataFrame(rows, "run long, t bigint, x double, y double, z double, v_east double, v_north double, v_up double")
    written, cut = [], smoothing.cut_lineage
    monkeypatch.setattr(smoothing, "cut_lineage", lambda df: written.append(df) or cut(df))
    got = smoothing.corrected_trajectory(d, ["run"], ["t"], 100).toPandas()
    assert len(written) == 3  # the blocks, their own solutions, one round
    assert len(got) == len(rows) and got["residual"].max() < 1e-8


def test_blocks_alike_are_solved_together(spark):
    rows = [(r, t, float(r)) for r in range(300) for t in range(5)]
    d = spark.createDataFrame(rows, "run long, t long, x double").coalesce(1)
    packed = smoothing._packed(d, ["run"], ["t"], ["x"], 100, 64)
    sizes = smoothing._each_block(packed, ["run"], ["x"], lambda part: {"size": [len(part["block"])] * len(part["block"])}, "size long", lambda row: (len(row.x),))
    assert sizes.count() == 300 and sizes.select("size").first()[0] >= 10


def test_transforms_carry_attitude_and_position(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0, 0.0, 0.0, 90.0)], "x_c double, y_c double, z_c double, rx double, ry double, az double")
    m = np.reshape(smoothing.with_transforms(d, "rx", "ry", "az").first()["transform"], (4, 4))
    assert np.allclose(m[:3, 3], [1, 2, 3]) and np.allclose(m[3], [0, 0, 0, 1]) and np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3))
    assert np.allclose(m[:3, :3] @ [0, 1, 0], [1, 0, 0])  # forward looks east


def tilted(rng, n, noise=0.005):
    out = []
    for _ in range(n):
        x, y = rng.uniform(-5, 5), rng.uniform(-5, 5)
        out.append((x, y, 0.1 * x - 0.05 * y + 2 + rng.gauss(0, noise)))
    return out


def test_planes_are_found_among_outliers(spark):
    rng = random.Random(5)
    pts = tilted(rng, 300) + [(rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(3, 6)) for _ in range(60)]
    d = spark.createDataFrame([("a", i, *p) for i, p in enumerate(pts)], "k string, id bigint, x double, y double, z double")
    r = registration.ransac_planes(d, ["k"], "id", 0.05, 30).first()
    n = np.array([-0.1, 0.05, 1.0]) / np.linalg.norm([-0.1, 0.05, 1.0])
    assert np.dot(n, [r.nx, r.ny, r.nz]) > 0.9995 and r.n_inliers >= 290
    again = registration.ransac_planes(d.repartition(5), ["k"], "id", 0.05, 30).first()
    assert again.n_inliers == r.n_inliers and again.nx == pytest.approx(r.nx, abs=1e-12)


def test_planes_of_many_keys_are_drawn_together(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, i, *p) for k in range(40) for i, p in enumerate(tilted(rng, rng.randint(4, 30), 0.02))]
    rows += [(7, 900 + i, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(3, 6)) for i in range(90)] + [(50, i, 1.0, 1.0, 1.0) for i in range(20)]
    d = spark.createDataFrame(rows, "k bigint, id bigint, x double, y double, z double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # keys go on over several batches
    try:
        small = registration.ransac_planes(d, ["k"], "id", 0.05, up=(0.0, 0.0, 1.0), max_tilt_deg=30.0)
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "min_by" not in plan and plan.count("Exchange") == 1
        got = {r.k: r for r in small.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for limit in (0, 50):  # all keys by partial aggregates, and the crowded one only
        monkeypatch.setattr(registration, "SMALL_KEY", limit)
        want = {r.k: r for r in registration.ransac_planes(d, ["k"], "id", 0.05, up=(0.0, 0.0, 1.0), max_tilt_deg=30.0).collect()}
        assert got.keys() == want.keys() and 20 < len(got) < 41 and 7 in got
        for k, r in got.items():
            assert (r.n_fit, r.n_inliers) == (want[k].n_fit, want[k].n_inliers)
            assert list(r)[1:7] == pytest.approx(list(want[k])[1:7], abs=1e-9) and r.error == pytest.approx(want[k].error, abs=1e-6)


def test_objects_stand_on_the_support_plane(spark):
    rng = random.Random(6)
    ground = [(rng.uniform(-10, 10), rng.uniform(-10, 10), rng.gauss(0, 0.01)) for _ in range(400)]
    car = [(2 + rng.uniform(0, 1), 3 + rng.uniform(0, 1), rng.uniform(0.4, 1.2)) for _ in range(80)]
    d = spark.createDataFrame([("s", i, *p) for i, p in enumerate(ground + car)], "k string, id bigint, x double, y double, z double")
    planes = registration.support_planes(d, ["k"], "id", threshold=0.05, min_points=100)
    got = registration.objects_above_plane(d, planes, ["k"], "id", 0.2, 2.0, eps=0.75, min_size=50).collect()
    assert len(got) == 1 and got[0].n_points == 80
    assert abs(got[0].z_min) < 0.1 and 2 <= got[0].x_min < got[0].x_max <= 3


def test_highest_support_plane_of_many(spark):
    """The highest plane has the fewest points, so it is found last; the other scan has one plane only."""
    rng = random.Random(9)
    levels = [("s", 2.0 * g, 1280 // 4**g) for g in range(4)] + [("t", 1.0, 200)]
    flat = [(k, rng.uniform(-10, 10), rng.uniform(-10, 10), z + rng.gauss(0, 0.005)) for k, z, n in levels for _ in range(n)]
    d = spark.createDataFrame([(k, i, x, y, z) for i, (k, x, y, z) in enumerate(flat)], "k string, id bigint, x double, y double, z double")
    got = {r.k: r for r in registration.support_planes(d, ["k"], "id", threshold=0.1, min_points=15, highest=True).collect()}
    assert abs(got["s"].pz - 6.0) < 0.1 and abs(got["t"].pz - 1.0) < 0.1


def cluttered(seed, planes, clutter, size=20.0):
    """Points of level planes (height, number) amid points anywhere."""
    rng = random.Random(seed)
    flat = [(rng.uniform(0, size), rng.uniform(0, size), z + rng.gauss(0, 0.01)) for z, n in planes for _ in range(n)]
    return flat + [(rng.uniform(0, size), rng.uniform(0, size), rng.uniform(0, 10)) for _ in range(clutter)]


def test_highest_plane_amid_clutter_for_every_seed(spark):
    scans = {f"s{k}": cluttered(k, [(1.5 * g, 100) for g in range(5)], 1000) for k in range(12)}
    scans |= {f"t{k}": cluttered(50 + k, [(0.0, 400), (1.5, 120)], 400) for k in range(12)}
    rows = [(k, i, *p) for k, pts in scans.items() for i, p in enumerate(pts)]
    d = spark.createDataFrame(rows, "k string, id bigint, x double, y double, z double")
    for seed in range(2):
        got = {r.k: r for r in registration.support_planes(d, ["k"], "id", threshold=0.05, min_points=100, highest=True, seed=seed).collect()}
        assert len(got) == 24
        for k, r in got.items():
            assert abs(r.pz - (6.0 if k[0] == "s" else 1.5)) < 0.05 and r.nz > 0.99 and r.n_inliers >= 100, (seed, k, r)


def test_steep_planes_explain_their_points(spark):
    rng = random.Random(3)
    wall = [(rng.gauss(0, 0.005), rng.uniform(0, 20), rng.uniform(0, 10)) for _ in range(400)]
    rows = [("w", i, *p) for i, p in enumerate(wall + cluttered(1, [(0.0, 200)], 50))] + [("w", 9999, None, 0.0, 0.0), ("bare", 1, 0.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "k string, id bigint, x double, y double, z double")
    found = sorted(registration.find_planes(d, ["k"], "id", threshold=0.05, min_points=100).collect(), key=lambda r: r.round)
    assert [(r.k, r.steep) for r in found] == [("w", True), ("w", False)] and found[0].n_inliers >= 395
    again = registration.find_planes(d.repartition(7), ["k"], "id", threshold=0.05, min_points=100).collect()
    assert sorted(again, key=lambda r: r.round) == found
    (r,) = registration.support_planes(d, ["k"], "id", threshold=0.05, min_points=100, highest=True).collect()
    assert abs(r.pz) < 0.05


def test_planes_of_a_large_scan():
    pts = np.array(cluttered(2, [(0.0, 30_000), (2.0, 600), (4.0, 400)], 20_000, size=60.0))
    found = registration.search_planes(pts, 0.05, 250, np.random.default_rng(1))
    heights = sorted(round(float(c[2]), 1) for n, c, _, k in found if n[2] > 0.99)
    assert heights[0] == 0.0 and 2.0 in heights


def test_chunk_alignment_finds_the_shift(spark):
    rng = random.Random(7)
    pts = [(c, i, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 3), rng.uniform(0, 1)) for c in (0, 1) for i in range(80)]
    target = spark.createDataFrame([(c, 1000 + i, x, y, z, s) for c, i, x, y, z, s in pts], "chunk int, t bigint, x double, y double, z double, i double")
    moved = [(c, i, x - 0.3 * (c + 1), y + 0.2, z - 0.1, s) for c, i, x, y, z, s in pts if i % 4]
    source = spark.createDataFrame(moved, "chunk int, id bigint, x double, y double, z double, i double")
    got = {r.chunk: r for r in registration.align_chunks(source, target, "chunk", "id", "t", {"x": 1.0, "y": 1.0, "z": 1.0, "i": 10.0}, 2.0).collect()}
    for c in (0, 1):
        assert (got[c].tx, got[c].ty, got[c].tz) == pytest.approx((0.3 * (c + 1), -0.2, 0.1), abs=1e-6)
        assert got[c].r00 == pytest.approx(1.0, abs=1e-9) and got[c].error < 1e-6


def test_flat_neighbourhoods_have_no_curvature(spark):
    rng = random.Random(8)
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(tilted(rng, 150, 0.0))], "id bigint, x double, y double, z double")
    rows = registration.normals(d, XYZ, "id", 12, 0.5).collect()
    n = np.array([-0.1, 0.05, 1.0]) / np.linalg.norm([-0.1, 0.05, 1.0])
    assert len(rows) == 150
    for r in rows:
        assert abs(np.dot(n, [r.nx, r.ny, r.nz])) == pytest.approx(1.0, abs=1e-6) and r.curvature < 1e-9


def test_lane_candidates_known_answer(spark):
    left = spark.createDataFrame([(0, 0.0, 2.0, 0.0)], "seq int, x double, y double, z double")
    right = spark.createDataFrame([(0, 0.0, -2.0, 0.0)], "seq int, x double, y double, z double")
    got = {r.lane_no: r.y for r in lanes.lane_candidates(left, right, ["seq"], 1, 2).collect()}
    assert got == {0: 2.0, 1: -2.0, 2: -6.0}


def test_frames_ahead_count_each_frame_once(spark):
    d = spark.createDataFrame([("r", f, 3.0) for f in range(12)], "run string, frame bigint, step double")
    got = {(r.frame, r.mark): r.ahead for r in lanes.frames_ahead(d, ["run"], "frame", "step", 10, (10.0, 20.0)).collect()}
    assert got[(0, 10.0)] == 4 and got[(0, 20.0)] == 8 and max(f for f, _ in got) == 3


def brute_rays(rays, planes, ahead):
    out = {}
    for run, ray, *o, dx, dy, dz in rays:
        o, u = np.array(o), np.array([dx, dy, dz]) / np.linalg.norm([dx, dy, dz])
        for prun, plane, *rest in planes:
            n, p = np.array(rest[:3]), np.array(rest[3:])
            if prun != run or u @ n == 0:
                continue
            t = (p - o) @ n / (u @ n)
            if ahead and t < 0:
                continue
            found = (np.linalg.norm(o + t * u - p), plane)
            out[run, ray] = min(out.get((run, ray), (np.inf, 0)), found)
    return out


@pytest.mark.parametrize("ahead", [False, True])
def test_rays_hit_the_plane_nearest_to_its_point_at_any_distance(spark, ahead):
    rng = np.random.default_rng(4)
    planes = [("r", k, *map(float, rng.normal(0, 1, 3)), *map(float, rng.uniform(-200, 200, 3))) for k in range(150)]
    planes += [("far", 0, 0.0, 0.1, 1.0, 10_000.0, 3.0, -2.0), ("far", 1, 0.0, 0.0, 1.0, 10_050.0, 0.0, 0.0), ("far", 2, 0.0, 0.0, 1.0, -10_000.0, 0.0, 0.0)]
    planes += [("flat", k, 0.0, 0.0, 1.0, float(3 * k), 0.0, 0.0) for k in range(400)] + [("flat", 9, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    rays = [("r", k, *map(float, rng.uniform(-300, 300, 3)), *map(float, rng.normal(0, 1, 3))) for k in range(60)]
    rays += [("far", 0, 0.0, 0.0, 5.0, 1.0, 0.0, -0.0005), ("flat", 0, 0.0, 0.0, 2.0, 1.0, 0.0, -0.19), ("flat", 1, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0), ("flat", 2, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0)]
    schema = "run string, plane int, nx double, ny double, nz double, px double, py double, pz double"
    odd = [("r", 900, None, 0.0, 1.0, 0.0, 0.0, 0.0), ("r", 901, 0.0, 0.0, 1.0, float("nan"), 0.0, 0.0), ("none", 1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    ray_schema = "run string, ray int, ox double, oy double, oz double, dx double, dy double, dz double"
    odd_rays = [("r", 900, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("r", 901, None, 0.0, 0.0, 1.0, 0.0, 0.0), ("lost", 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    got = lanes.rays_to_planes(spark.createDataFrame(rays + odd_rays, ray_schema), spark.createDataFrame(planes + odd, schema), ["run"], "ray", "plane", finest=5.0, ahead=ahead)
    got = {(r.run, r.ray): (r.dist, r.plane) for r in got.collect()}
    want = brute_rays(rays, planes, ahead)
    assert got.keys() == want.keys()
    for key, (dist, plane) in want.items():
        assert got[key][1] == plane and got[key][0] == pytest.approx(dist, rel=1e-9, abs=1e-9), key
    assert ("flat", 2) not in got and (("flat", 1) in got) != ahead and ("far", 0) in got


def test_overlap_share(spark):
    a = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0, 0.0, 2.0)], "id int, a_x_min double, a_x_max double, a_y_min double, a_y_max double, a_z_min double, a_z_max double")
    b = a.withColumns({"b_x_min": F.lit(1.0), "b_x_max": F.lit(3.0), **{f"b_{c}_{e}": F.col(f"a_{c}_{e}") for c in "yz" for e in ("min", "max")}})
    assert b.select(trace.overlap_share(XYZ, "a_", "b_").alias("s")).first().s == 0.5


def test_deskew_before_the_first_pose_mirrors_the_motion(spark):
    from wayline.operators import filters

    poses = spark.createDataFrame([("r", i, 1.0, 0.0, 0.0, 0.0, float(i), 0.0, 0.0) for i in range(6)], "run string, row bigint, q0 double, q1 double, q2 double, q3 double, px double, py double, pz double")
    pts = spark.createDataFrame([("r", 0, 0, 0.0, 0.0, 0.0), ("r", 1, 125_000, 0.0, 0.0, 0.0), ("r", 3, 75_000, 0.0, 0.0, 0.0)], "run string, frame bigint, dt_us bigint, x double, y double, z double")
    d = filters.deskew_by_offset(pts, poses, ["run"], "frame", "dt_us", "row", ["q0", "q1", "q2", "q3"], ["px", "py", "pz"], XYZ)
    assert {r.frame: round(r.x_map, 9) for r in d.collect()} == {0: 0.0, 1: -1.5, 3: 1.5}
    assert rotation.dot((1, 2), (3, 4)) == 11


def test_pixels_made_from_a_small_table_are_not_broadcast(spark):
    rows = spark.range(20).selectExpr("1 AS run", "id AS idx", "double(id) AS x")
    frames = rows.selectExpr("run", "idx AS frame", "x AS fx")
    pixels = frames.selectExpr("run", "frame", "explode(sequence(0L, 9L)) AS u", "0L AS v", "frame AS r", "u AS g", "v AS b")

    def to_pixel(d):
        return d.withColumns({"u": F.floor(F.col("x") - F.col("fx")), "v": F.lit(0).cast("bigint")})

    d = registration.colour_points(rows, frames, pixels, ["run"], "idx", "idx", "frame", 5, to_pixel)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "u#" in line]
    assert {r.idx: (r.r, r.g) for r in d.collect()} == {i: (i - 1, 1) if i else (None, None) for i in range(20)}


def test_sections_meet_no_pieces_without_points(spark):
    """Lane points far apart in number: a section is not copied to the empty stretches between them."""
    rows = [(1, 0, i * 10**12, float(i)) for i in range(40)] + [(1, 1, 7, 0.0)]
    lane = spark.createDataFrame(rows, "run int, lane_no int, seq bigint, x double")
    asked = [(1, 1, 0, 5 * 10**12, 30 * 10**12), (1, 2, 0, -3, 10**12 + 1), (1, 3, 0, 5, 6), (1, 4, 1, 7, 7), (1, 5, 0, 38 * 10**12, 10**15)]
    sections = spark.createDataFrame(asked, "run int, idx int, lane_no int, seq_from bigint, seq_to bigint")
    d = lanes.points_of_sections(sections, lane, ["run"], "idx", "seq", piece=8, width=2 * 10**12)
    got = sorted((r.idx, r.lane_no, r.seq) for r in d.collect())
    assert got == sorted((i, n, s) for _, i, n, a, b in asked for _, m, s, _ in rows if m == n and a <= s <= b)


def test_calibration_turns_are_worked_out_once(spark):
    points = spark.createDataFrame([(0, 1.0, 2.0, 30.0)], "cam int, x double, y double, z double")
    edges = spark.createDataFrame([(0, 164, 98, 3.0)], "cam int, u long, v long, strength double")
    d = registration.score_calibration(points, edges, ["cam"], (120.0, 120.0), (160.0, 90.3), (320, 180))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "SIN(" not in plan and "COS(" not in plan
    scores = {r["candidate"]: r["score"] for r in d.collect()}
    assert len(scores) == 27 and scores[13] == 3.0


def test_calibration_counts_are_not_broadcast(spark):
    """Points that look few to the planner become 27 times as many pixels, which the driver must not collect."""
    rows = [(i % 3, i % 50 - 25.0, i % 35 - 17.0, 20.0 + i % 11) for i in range(500)]
    points = spark.range(500).selectExpr("id % 3 AS cam", "id % 50 - 25.0D AS x", "id % 35 - 17.0D AS y", "20.0D + id % 11 AS z")
    edges = spark.createDataFrame([(c, u, v, float(u % 7)) for c in range(3) for u in range(10, 300) for v in range(5, 170, 3)], "cam long, u long, v long, strength double")
    d = registration.score_calibration(points, edges, ["cam"], (120.0, 120.0), (160.0, 90.3), (320, 180))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "u#" in line]
    want = 0.0
    for _, x, y, z in rows:
        u, v = round(120.0 * x / z + 160.0), round(120.0 * y / z + 90.3)
        want += float(u % 7) if 10 <= u < 300 and 5 <= v < 170 and (v - 5) % 3 == 0 else 0.0
    assert {r["candidate"]: r["score"] for r in d.collect()}[13] == want > 0


def test_small_scans_are_searched_together(spark):
    """Many small scans at a time give the planes of one after the other, however scans are put together."""
    rng = random.Random(12)
    scans = [np.array(cluttered(k, [(1.5 * g, rng.randrange(6, 30)) for g in range(3)], rng.randrange(0, 40))) for k in range(60)]
    scans += [np.zeros((0, 3)), np.zeros((5, 3)), np.zeros((20, 3)), np.arange(60.0).reshape(20, 3)]
    each = [registration.search_planes(p, 0.05, 8, np.random.default_rng(k)) for k, p in enumerate(scans)]
    both = registration.search_planes_together(scans, 0.05, 8, [np.random.default_rng(k) for k in range(len(scans))])
    assert sum(map(len, each)) > 60
    for one, other in zip(each, both):
        assert [k for *_, k in one] == [k for *_, k in other]
        for (n, c, e, _), (m, d, f, _) in zip(one, other):
            assert np.allclose(n, m, atol=1e-7) and np.allclose(c, d, atol=1e-6) and e == pytest.approx(f, abs=1e-7)
    rows = [(f"s{k}", i, *map(float, p)) for k, scan in enumerate(scans) for i, p in enumerate(scan)]
    d = spark.createDataFrame(rows, "k string, id bigint, x double, y double, z double")
    found = registration.find_planes(d, ["k"], "id", threshold=0.05, min_points=8)
    assert "_bucket" in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.k, r.round, r.n_inliers) for r in found.collect())
    again = sorted((r.k, r.round, r.n_inliers) for r in registration.find_planes(d.repartition(5), ["k"], "id", threshold=0.05, min_points=8).collect())
    assert got == again and len(got) > 60
