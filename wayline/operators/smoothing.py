"""Trajectory smoothers: exact on runs of any length, whatever the blocks they are cut into.

A run is cut into blocks of consecutive rows. Each block is first reduced to a
few numbers that say what it does to the state at its edges; these are chained
along the run, which is short, and give every block the exact state to start
from; then the blocks are solved on their own. No task holds a whole run's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wayline.functions import rotation
from wayline.operators import blocks
from wayline.session import cut_lineage

XYZ = ["x", "y", "z"]

# fixed values: variances of the filter, weights and limit of the bias-corrected trajectory
INS_VAR, SCAN_VAR, VELOCITY_VAR = 1.0, 0.1, 0.5
START_VAR = (0.01, 0.3, 0.3)
ODOMETRY_VAR, BIAS_VAR, GPS_VAR = 0.1, 0.5, (0.5, 0.5, 1.5)
BIAS_DECAY, BIAS_LIMIT, STEP_S = 0.999, 2.0, 1 / 50


def _inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of 2 x 2 matrices in the last two axes."""
    out = np.empty_like(m)
    out[..., 0, 0], out[..., 1, 1] = m[..., 1, 1], m[..., 0, 0]
    out[..., 0, 1], out[..., 1, 0] = -m[..., 0, 1], -m[..., 1, 0]
    return out / (m[..., 0, 0] * m[..., 1, 1] - m[..., 0, 1] * m[..., 1, 0])[..., None, None]


def _apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def _packed(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], width: float, block_rows: int) -> DataFrame:
    """One row per block, written: each column as an array, ``before_c`` and ``after_c`` of the neighbouring rows.

    Missing numbers are nan; a block at an end of its run has nan neighbours.
    """
    d = blocks.halo_blocks(df, keys, order, width, block_rows, 1)
    d = d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols})
    rows = d.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "own", *order, *cols))).alias("_r"))
    own = F.filter("_r", lambda r: r["own"])
    first = F.col("block") * block_rows
    before = F.filter("_r", lambda r: r["pos"] < first)
    after = F.filter("_r", lambda r: r["pos"] >= first + block_rows)
    nan = F.lit(float("nan"))

    def column(rows, c):
        return F.transform(rows, lambda r: r[c])

    def pick(rows, c):
        return F.coalesce(F.get(column(rows, c), F.lit(0)), nan)

    return cut_lineage(
        rows.where(F.exists("_r", lambda r: r["own"])).select(
            *keys, "block", *[column(own, c).alias(c) for c in [*order, *cols]],
            *[pick(before, c).alias(f"before_{c}") for c in cols], *[pick(after, c).alias(f"after_{c}") for c in cols],
        )
    )


#: rows of the blocks that a task solves at once; blocks of one kind go through each step as further axes
STACK_ROWS = 65536


def _axes(part: dict, names: Sequence[str]) -> np.ndarray:
    """(rows, axes of all blocks) of a stack's arrays."""
    blocks_first = np.stack([part[n] for n in names], axis=2)
    return np.swapaxes(blocks_first, 0, 1).reshape(blocks_first.shape[1], -1)


def _neighbour(part: dict, side: str, names: Sequence[str]) -> np.ndarray:
    return np.stack([part[f"{side}_{n}"] for n in names], axis=1).ravel()


def _by_block(v: np.ndarray, size: int = 3) -> list:
    """(rows, axes of all blocks) back to one (axes, rows) array per block."""
    return list(np.moveaxis(v.reshape(len(v), -1, size), 0, 2))


def _flat(v: np.ndarray, count: int) -> list:
    """(axes of all blocks, ...) as one plain array per block."""
    return list(v.reshape(count, -1))


def _stacks(pdf: pd.DataFrame, kind: Callable) -> Iterator[tuple[pd.DataFrame, dict]]:
    """Rows of the same ``kind``, whose first item is the length, with each column's values stacked; at most ``STACK_ROWS`` long in all."""
    by_kind: dict = {}
    for at, row in enumerate(pdf.itertuples(index=False)):
        by_kind.setdefault(kind(row), []).append(at)
    for (n, *_), rows in by_kind.items():
        step = max(1, STACK_ROWS // max(n, 1))
        for at in range(0, len(rows), step):
            some = pdf.iloc[rows[at : at + step]]
            yield some, {c: np.stack(some[c].to_numpy()) if some[c].dtype == object else some[c].to_numpy() for c in some.columns}


def _block_kind(row) -> tuple:
    """Rows, and whether the block is its run's first or last: blocks alike in these are solved together."""
    return len(row.x), row.block == 0, bool(np.isnan(row.after_x))


def _each_block(df: DataFrame, keys: Sequence[str], columns: Sequence[str], solve: Callable, out: str, kind: Callable = _block_kind) -> DataFrame:
    """``solve(stack of blocks of one kind)`` gives the named values, one per block; ``out`` is their schema."""
    types = dict(df.dtypes)
    key_schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "block long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some, part in _stacks(pdf, kind):
                found = {n: list(v) for n, v in solve({n: part[n] for n in ("block", *columns)}).items()}
                yield pd.DataFrame({**{k: some[k].to_numpy() for k in (*keys, "block")}, **found})

    return df.select(*keys, "block", *columns).mapInPandas(run, f"{key_schema}, {out}")


def _chain(df: DataFrame, keys: Sequence[str], columns: Sequence[str], solve: Callable, out: str, kind: Callable | None = None) -> DataFrame:
    """``solve(stack of runs, number of blocks)`` on the blocks' summaries in order; per block a list of values, one per run.

    Runs of as many blocks, and of one ``kind``, are solved together.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "block long", out])
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("_r"))

    def column(c):
        values = F.transform("_r", lambda r: r[c])
        return (F.flatten(values) if types[c].startswith("array") else values).alias(c)

    def alike(row) -> tuple:
        return len(row.block), *(kind(row) if kind else ())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some, part in _stacks(pdf, alike):
                n, count = part["block"].shape[1], len(some)
                # block by block, the values of all runs
                solved = solve({c: list(np.swapaxes(part[c].reshape(count, n, -1), 0, 1)) for c in columns}, n)
                for at in range(n):
                    found = {name: list(v[at]) for name, v in solved.items()}
                    yield pd.DataFrame({**{k: some[k].to_numpy() for k in keys}, "block": part["block"][:, at], **found})

    return rows.select(*keys, *[column(c) for c in ("block", *columns)]).mapInPandas(run, schema)


def _rows_of(packed: DataFrame, solved: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Blocks with arrays ``names`` back to rows."""
    d = packed.select(*keys, "block", *order).join(solved.select(*keys, "block", *names), [*keys, "block"])
    return d.select(*keys, F.explode(F.arrays_zip(*order, *names)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *names]])


STEP = np.array([[1.0, 1.0], [0.0, 1.0]])


def _noise(pos: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Process noise (n, axes, 2, 2) of the step to each row: ten times the way on the position, the way on the velocity."""
    way = np.abs(np.diff(pos, axis=0, prepend=before[None]))
    out = np.zeros((*way.shape, 2, 2))
    out[..., 0, 0], out[..., 1, 1] = 10 * way, way
    return out


def _seen(pos: np.ndarray, scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position and variance per row that tell as much as the INS position and, where there is one, the scan match."""
    both = np.repeat(~np.isnan(scan).reshape(len(scan), -1, 3).any(axis=2), 3, axis=1)
    weight = 1 / INS_VAR + np.where(both, 1 / SCAN_VAR, 0.0)
    return (pos / INS_VAR + np.where(both, scan, 0.0) / SCAN_VAR) / weight, np.broadcast_to(1 / weight, pos.shape)


def filter_element(z: np.ndarray, var: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a run of rows does to the filter's state, by composition of single rows.

    The elements and their product are those of the parallel Kalman filter of
    Sarkka and Garcia-Fernandez (2021); (A, b, C, eta, J) per axis.
    """
    axes = z.shape[1]
    one = np.broadcast_to(np.eye(2), (axes, 2, 2))
    a, b, c, eta, j = one.copy(), np.zeros((axes, 2)), np.zeros((axes, 2, 2)), np.zeros((axes, 2)), np.zeros((axes, 2, 2))
    ones = np.ones((axes, 2))
    for t in range(len(z)):
        s = noise[t, :, 0, 0] + var[t]
        gain = noise[t, :, :, 0] / s[:, None]
        keep = one - gain[:, :, None] * np.array([1.0, 0.0])
        a2, b2, c2 = keep @ STEP, gain * z[t][:, None], keep @ noise[t]
        eta2, j2 = ones * (z[t] / s)[:, None], np.ones((axes, 2, 2)) / s[:, None, None]
        ahead = a2 @ _inverse(one + c @ j2)
        back = _t(a) @ _inverse(one + j2 @ c)
        eta, j = _apply(back, eta2 - _apply(j2, b)) + eta, back @ j2 @ a + j
        a, b, c = ahead @ a, _apply(ahead, b + _apply(c, eta2)) + b2, ahead @ c @ _t(a2) + c2
    return a, b, c, eta, j


def after_element(state: tuple[np.ndarray, np.ndarray], element: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Filtered mean and covariance behind the rows of ``element``."""
    (m, p), (a, b, c, eta, j) = state, element
    ahead = a @ _inverse(np.eye(2) + p @ j)
    return _apply(ahead, m + _apply(p, eta)) + b, ahead @ p @ _t(a) + c


def filter_rows(state, z, var, noise) -> tuple[np.ndarray, ...]:
    """Filtered and predicted means (n, axes, 2) and covariances behind each row."""
    n, axes = z.shape
    m, p, pm, pp = np.empty((n, axes, 2)), np.empty((n, axes, 2, 2)), np.empty((n, axes, 2)), np.empty((n, axes, 2, 2))
    mean, cov = state
    for t in range(n):
        mean, cov = _apply(STEP, mean), STEP @ cov @ STEP.T + noise[t]
        pm[t], pp[t] = mean, cov
        gain = cov[:, :, 0] / (cov[:, 0, 0] + var[t])[:, None]
        mean = mean + gain * (z[t] - mean[:, 0])[:, None]
        cov = cov - gain[:, :, None] * cov[:, None, 0, :]
        m[t], p[t] = mean, cov
    return m, p, pm, pp


def smooth_rows(m, p, pm, pp, state) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed means and covariances; ``pm`` and ``pp`` predict the row behind each, ``state`` is smoothed behind the last (None at a run's end)."""
    sm, sp = m.copy(), p.copy()
    for t in range(len(m) - 1, -1, -1):
        if state is not None:
            gain = p[t] @ STEP.T @ _inverse(pp[t])
            sm[t] = m[t] + _apply(gain, state[0] - pm[t])
            sp[t] = p[t] + gain @ (state[1] - pp[t]) @ _t(gain)
        state = sm[t], sp[t]
    return sm, sp


def _block_rows(part) -> tuple[np.ndarray, ...]:
    """Positions, measurement, its variance, process noise; and the noise of the step out of the block (nan at the end)."""
    pos = _axes(part, XYZ)
    z, var = _seen(pos, pos + _axes(part, ["ix", "iy", "iz"]))
    noise = _noise(pos, _neighbour(part, "before", XYZ))
    return pos, z, var, noise, _noise(_neighbour(part, "after", XYZ)[None], pos[-1])[0]


def _start(part, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State of a run's first row: its position, and the way to the second row as velocity."""
    second = pos[1] if len(pos) > 1 else np.where(np.isnan(nxt := _neighbour(part, "after", XYZ)), pos[0], nxt)
    p = np.zeros((pos.shape[1], 2, 2))
    p[:, 0, 0], p[:, 1, 1] = np.tile(START_VAR, pos.shape[1] // 3), VELOCITY_VAR
    return np.stack([pos[0], second - pos[0]], axis=1), p


def _is_first(part) -> bool:
    return bool(part["block"][0] == 0)


def _is_last(part) -> bool:
    return bool(np.isnan(part["after_x"][0]))


def _filtered_block(part) -> tuple[np.ndarray, ...]:
    """Filtered rows of the blocks from the state before them, and the prediction of the row behind each."""
    pos, z, var, noise, out_noise = _block_rows(part)
    if _is_first(part):
        m0, p0 = _start(part, pos)
        m, p, pm, pp = filter_rows((m0, p0), z[1:], var[1:], noise[1:])
        m, p = np.concatenate([m0[None], m]), np.concatenate([p0[None], p])
    else:
        m, p, pm, pp = filter_rows((part["in_m"].reshape(-1, 2), part["in_p"].reshape(-1, 2, 2)), z, var, noise)
        pm, pp = pm[1:], pp[1:]
    pm, pp = np.concatenate([pm, _apply(STEP, m[-1])[None]]), np.concatenate([pp, (STEP @ p[-1] @ STEP.T + out_noise)[None]])
    return m, p, pm, pp


def smooth_trajectory(poses: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, block_rows: int = 8192) -> DataFrame:
    """Kalman filter and RTS smoother per run: ``x_f..`` filtered, ``x_s..`` smoothed, ``var_f_x..``, ``var_s_x..``.

    ``poses`` holds x, y, z and the scan-match increment ix, iy, iz (null when
    none). State per axis: position and velocity, one step a row. The blocks
    only bound a task's memory. Writes the blocks and their states when called.
    """
    keys, order = list(keys), list(order)
    cols = [*XYZ, "ix", "iy", "iz"]
    packed = _packed(poses.select(*keys, *order, *cols), keys, order, cols, width, block_rows)
    inputs = [*cols, *[f"{s}_{c}" for s in ("before", "after") for c in XYZ]]

    def element(part):
        pos, z, var, noise, _ = _block_rows(part)
        axes, skip = pos.shape[1], int(_is_first(part))
        m, p = _start(part, pos) if skip else (np.zeros((axes, 2)), np.zeros((axes, 2, 2)))
        parts = filter_element(z[skip:], var[skip:], noise[skip:])
        return {n: _flat(v, axes // 3) for n, v in zip(("m", "p", "a", "b", "c", "eta", "j"), (m, p, *parts))}

    doubles = "array<double>"
    names = ("m", "p", "a", "b", "c", "eta", "j")
    shape = {"m": (-1, 2), "p": (-1, 2, 2), "a": (-1, 2, 2), "b": (-1, 2), "c": (-1, 2, 2), "eta": (-1, 2), "j": (-1, 2, 2)}
    elements = _each_block(packed, keys, inputs, element, ", ".join(f"{n} {doubles}" for n in names))

    def forward(runs, n):
        state, out = None, {"in_m": [], "in_p": []}
        for at in range(n):
            r = {c: runs[c][at].reshape(shape[c]) for c in names}
            state = state or (r["m"], r["p"])
            for c, v in zip(("in_m", "in_p"), state):
                out[c].append(_flat(v, len(runs["m"][at])))
            state = after_element(state, tuple(r[c] for c in ("a", "b", "c", "eta", "j")))
        return out

    states = cut_lineage(_chain(elements, keys, names, forward, f"in_m {doubles}, in_p {doubles}"))
    ready = packed.join(states, [*keys, "block"])
    inputs += ["in_m", "in_p"]

    def backward_element(part):
        """Smoothed state of the block's first row as gain, offset and covariance on the one behind its last row."""
        m, p, pm, pp = _filtered_block(part)
        axes = m.shape[1]
        e = np.broadcast_to(np.eye(2), (axes, 2, 2)).copy()
        g, spread = np.zeros((axes, 2)), np.zeros((axes, 2, 2))
        last = _is_last(part)
        for t in range(len(m) - 1, -1, -1):
            if last and t == len(m) - 1:
                e, g, spread = np.zeros((axes, 2, 2)), m[t], p[t]
                continue
            gain = p[t] @ STEP.T @ _inverse(pp[t])
            e, g, spread = gain @ e, m[t] + _apply(gain, g - pm[t]), p[t] + gain @ (spread - pp[t]) @ _t(gain)
        return {"e": _flat(e, axes // 3), "g": _flat(g, axes // 3), "l": _flat(spread, axes // 3)}

    backs = _each_block(ready, keys, inputs, backward_element, ", ".join(f"{n} {doubles}" for n in "egl"))

    def backward(runs, n):
        count = len(runs["e"][0])
        state, out = (np.zeros((3 * count, 2)), np.zeros((3 * count, 2, 2))), []
        for at in range(n - 1, -1, -1):
            out.append((_flat(state[0], count), _flat(state[1], count)))
            e = runs["e"][at].reshape(-1, 2, 2)
            state = _apply(e, state[0]) + runs["g"][at].reshape(-1, 2), e @ state[1] @ _t(e) + runs["l"][at].reshape(-1, 2, 2)
        return {"out_m": [m for m, _ in out[::-1]], "out_p": [p for _, p in out[::-1]]}

    ends = cut_lineage(_chain(backs, keys, "egl", backward, f"out_m {doubles}, out_p {doubles}"))
    names = [*[f"{c}_f" for c in XYZ], *[f"{c}_s" for c in XYZ], *[f"var_f_{c}" for c in XYZ], *[f"var_s_{c}" for c in XYZ]]

    def solve(part):
        m, p, pm, pp = _filtered_block(part)
        state = None if _is_last(part) else (part["out_m"].reshape(-1, 2), part["out_p"].reshape(-1, 2, 2))
        sm, sp = smooth_rows(m, p, pm, pp, state)
        values = [_by_block(v) for v in (m[:, :, 0], sm[:, :, 0], p[:, :, 0, 0], sp[:, :, 0, 0])]
        return {n: [block[k % 3] for block in values[k // 3]] for k, n in enumerate(names)}

    solved = _each_block(ready.join(ends, [*keys, "block"]), keys, [*inputs, "out_m", "out_p"], solve, ", ".join(f"{n} {doubles}" for n in names))
    return _rows_of(packed, solved, keys, order, names)


# Bias-corrected trajectories. Axes come first in all arrays; the unknowns of a row are (x, b).


def _system(gps, velocity, before_v, first: bool, last: bool, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal blocks (n, axes, 2, 2) and right-hand side (n, axes, 2) of the normal equations of some rows of runs."""
    n, axes = gps.shape
    wo, wb, wg = 1 / ODOMETRY_VAR, 1 / BIAS_VAR, np.tile(1 / np.array(GPS_VAR), axes // 3)
    diag, rhs = np.zeros((n, axes, 2, 2)), np.zeros((n, axes, 2))
    diag += wg[:, None, None] * np.array([[1.0, -1.0], [-1.0, 1.0]])
    rhs[:, :, 0] += wg * gps
    rhs[:, :, 1] -= wg * gps
    if first and last and n == 1:  # nothing tells position and bias apart: no bias
        diag[:, :, 1, 1] += wb
    into = np.ones(n)
    into[0] = not first
    out = np.ones(n)
    out[-1] = not last
    diag[:, :, 0, 0] += wo * (into + out)[:, None]
    diag[:, :, 1, 1] += wb * (into + BIAS_DECAY**2 * out)[:, None]
    arriving = np.concatenate([np.where(first, 0.0, np.nan_to_num(before_v))[None], velocity[:-1]])
    rhs[:, :, 0] += wo * dt * (arriving - velocity * out[:, None])
    return diag, rhs


#: coupling of a row with the next one: diagonal, on (x, b)
COUPLING = np.array([-1 / ODOMETRY_VAR, -BIAS_DECAY / BIAS_VAR])


def _held(diag, rhs, fixed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The system inside a block with the biases of ``fixed`` (n, axes; nan where free) put in; couplings (n - 1, axes, 2)."""
    d, r = diag.copy(), rhs.copy()
    held = ~np.isnan(fixed)
    b = np.where(held, fixed, 0.0)
    r[:, :, 0] -= d[:, :, 0, 1] * b
    r[1:, :, 1] -= COUPLING[1] * b[:-1]
    r[:-1, :, 1] -= COUPLING[1] * b[1:]
    d[held, 0, 1] = d[held, 1, 0] = 0.0
    d[held, 1, 1] = 1.0
    r[held, 1] = fixed[held]
    link = np.broadcast_to(COUPLING, (max(len(d) - 1, 0), d.shape[1], 2)).copy()
    link[held[:-1] | held[1:], 1] = 0.0
    return d, r, link


def _edges(d, r, link) -> tuple[np.ndarray, ...]:
    """The block's equations in its first and last row only: [[A, G'], [G, C]] (u0, un) = (p, q)."""
    a, p = d[0].copy(), r[0].copy()
    if len(d) == 1:
        return a, np.zeros_like(a), a, p, p
    dt, rt, g = d[1], r[1], link[0][:, :, None] * np.eye(2)
    for t in range(1, len(d) - 1):
        inv = _inverse(dt)
        down = link[t][:, :, None] * inv
        a = a - _t(g) @ inv @ g
        p = p - _apply(_t(g) @ inv, rt)
        dt, rt, g = d[t + 1] - down * link[t][:, None, :], r[t + 1] - _apply(down, rt), -down @ g
    return a, g, dt, p, rt


def _chain_edges(parts: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and last unknowns of every block of runs, from the blocks' edge equations and couplings."""
    nodes, links = [], []
    for k, s in enumerate(parts):
        rows = [(s["a"].copy(), s["p"].copy())] if s["n"] == 1 else [(s["a"].copy(), s["p"].copy()), (s["c"].copy(), s["q"].copy())]
        if k:
            before, here = parts[k - 1]["last_fixed"], s["first_fixed"]
            link = np.broadcast_to(COUPLING, (len(here), 2)).copy()
            link[~np.isnan(before) | ~np.isnan(here), 1] = 0.0
            # a held bias enters the other side's equation as a known number
            rows[0][1][:, 1] -= np.where(np.isnan(here), COUPLING[1] * np.nan_to_num(before), 0.0)
            nodes[-1][1][:, 1] -= np.where(np.isnan(before), COUPLING[1] * np.nan_to_num(here), 0.0)
            links.append(link[:, :, None] * np.eye(2))
        nodes.append(rows[0])
        if s["n"] > 1:
            links.append(s["g"])
            nodes.append(rows[1])
    for t in range(1, len(nodes)):
        f = links[t - 1] @ _inverse(nodes[t - 1][0])
        nodes[t] = nodes[t][0] - f @ _t(links[t - 1]), nodes[t][1] - _apply(f, nodes[t - 1][1])
    u = [None] * len(nodes)
    u[-1] = _apply(_inverse(nodes[-1][0]), nodes[-1][1])
    for t in range(len(nodes) - 2, -1, -1):
        u[t] = _apply(_inverse(nodes[t][0]), nodes[t][1] - _apply(_t(links[t]), u[t + 1]))
    out, at = [], 0
    for s in parts:
        size = 1 if s["n"] == 1 else 2
        out.append((u[at], u[at + size - 1]))
        at += size
    return out


def _between(d, r, link, first, last) -> np.ndarray:
    """All unknowns (n, axes, 2) of a block with those of its first and last row given."""
    n = len(d)
    u = np.empty_like(r)
    u[0], u[-1] = first, last
    if n <= 2:
        return u
    d, r = d[1:-1].copy(), r[1:-1].copy()
    r[0] -= link[0] * first
    r[-1] -= link[-1] * last
    inner = link[1:-1]
    for t in range(1, n - 2):
        f = inner[t - 1][:, :, None] * _inverse(d[t - 1])
        d[t] -= f * inner[t - 1][:, None, :]
        r[t] -= _apply(f, r[t - 1])
    u[-2] = _apply(_inverse(d[-1]), r[-1])
    for t in range(n - 4, -1, -1):
        u[t + 1] = _apply(_inverse(d[t]), r[t] - inner[t] * u[t + 2])
    return u


def _gradient(u, diag, rhs, before, after) -> np.ndarray:
    """Gradient (n, axes) on the biases; ``before`` and ``after`` are those of the rows around."""
    b = u[:, :, 1]
    grad = diag[:, :, 1, 0] * u[:, :, 0] + diag[:, :, 1, 1] * b - rhs[:, :, 1]
    return grad + COUPLING[1] * (np.concatenate([before[None], b[:-1]]) + np.concatenate([b[1:], after[None]]))


def _next_fixed(fixed, u, grad) -> np.ndarray:
    """Biases beyond the limit are held there; held ones whose gradient points inward are freed."""
    b = u[:, :, 1]
    beyond = np.where(b > BIAS_LIMIT + 1e-9, BIAS_LIMIT, np.where(b < -BIAS_LIMIT - 1e-9, -BIAS_LIMIT, np.nan))
    inward = fixed * grad > 1e-9  # false where free
    return np.where(np.isnan(fixed), beyond, np.where(inward, np.nan, fixed))


def _held_alone(gps, velocity, dt: float, most_rounds: int) -> np.ndarray:
    """Biases held if the rows were runs of their own: where to start from, so nothing hangs on the last round."""
    diag, rhs = _system(gps, velocity, np.zeros(gps.shape[1]), True, True, dt)
    fixed, zero = np.full(gps.shape, np.nan), np.zeros(gps.shape[1])
    for _ in range(most_rounds):
        d, r, link = _held(diag, rhs, fixed)
        ends = _edges(d, r, link)
        first, last = _chain_edges([{"n": len(d), "first_fixed": fixed[0], "last_fixed": fixed[-1], **dict(zip("agcpq", ends))}])[0]
        u = _between(d, r, link, first, last)
        new = _next_fixed(fixed, u, _gradient(u, diag, rhs, zero, zero))
        if np.array_equal(np.isnan(new), np.isnan(fixed)):
            break
        fixed = new
    return fixed


def corrected_trajectory(
    poses: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, dt: float = STEP_S, block_rows: int = 8192, most_rounds: int = 100
) -> DataFrame:
    """Bias-corrected positions ``x_c, y_c, z_c`` and biases ``b_x..`` from x, y, z and v_east, v_north, v_up.

    They minimise odometry, bias-drift and GPS residuals with every bias within
    its limit. The normal equations are block tridiagonal: each block is reduced
    to its two edge rows, the edges are solved along the run, and the rows
    between follow. Held biases start from those of each block on its own and
    are renewed in rounds; a run leaves when none of its own changes. A round is
    a few jobs, and ``most_rounds`` without an end raises an error. ``residual``
    is the gradient of the bias where it is free, 0 where held. Writes the
    blocks and each round's results when called.
    """
    keys, order = list(keys), list(order)
    v = ["v_east", "v_north", "v_up"]
    packed = _packed(poses.select(*keys, *order, *XYZ, *v), keys, order, [*XYZ, *v], width, block_rows)
    doubles = "array<double>"
    inputs = [*XYZ, *v, *[f"before_{c}" for c in v], "after_x"]

    kept = ", ".join([*[f"{c} {doubles}" for c in [*XYZ, *v]], *[f"{c} double" for c in inputs[6:]]])

    def alone(part):
        fixed = _held_alone(_axes(part, XYZ), _axes(part, v), dt, most_rounds)
        return {**{c: part[c] for c in inputs}, "fixed": [np.ravel(f.T) for f in _by_block(fixed)]}

    def system(part):
        gps, velocity = _axes(part, XYZ), _axes(part, v)
        diag, rhs = _system(gps, velocity, _neighbour(part, "before", v), _is_first(part), _is_last(part), dt)
        fixed = np.swapaxes(part["fixed"].reshape(-1, len(gps), 3), 0, 1).reshape(gps.shape)
        return diag, rhs, fixed

    def summary(part):
        diag, rhs, fixed = system(part)
        count = len(part["fixed"])
        parts = _edges(*_held(diag, rhs, fixed))
        return {
            "n": [len(diag)] * count, "first_fixed": _flat(fixed[0], count), "last_fixed": _flat(fixed[-1], count),
            **{n: _flat(x, count) for n, x in zip("agcpq", parts)},
        }

    shape = {"a": (-1, 2, 2), "g": (-1, 2, 2), "c": (-1, 2, 2), "p": (-1, 2), "q": (-1, 2), "first_fixed": (-1,), "last_fixed": (-1,)}

    def edges(runs, n):
        count = len(runs["n"][0])
        ends = _chain_edges([{"n": int(runs["n"][at].flat[0]), **{c: runs[c][at].reshape(s) for c, s in shape.items()}} for at in range(n)])
        zero = np.zeros(3 * count)
        found = {
            "first": [a for a, _ in ends],
            "last": [b for _, b in ends],
            "b_before": [zero, *[b[:, 1] for _, b in ends[:-1]]],
            "b_after": [*[a[:, 1] for a, _ in ends[1:]], zero],
        }
        return {c: [_flat(x, count) for x in xs] for c, xs in found.items()}

    def single_rows(row) -> tuple:
        return (tuple(k == 1 for k in row.n),)

    names = [*[f"{c}_c" for c in XYZ], *[f"b_{c}" for c in XYZ], "residual"]
    end_names = ("first", "last", "b_before", "b_after")

    def solve(part):
        diag, rhs, fixed = system(part)
        d, r, link = _held(diag, rhs, fixed)
        u = _between(d, r, link, part["first"].reshape(-1, 2), part["last"].reshape(-1, 2))
        grad = _gradient(u, diag, rhs, part["b_before"].ravel(), part["b_after"].ravel())
        new = _next_fixed(fixed, u, grad)
        left = np.where(np.isnan(fixed), np.abs(grad), 0.0)
        x, b, left, changes = map(_by_block, (u[:, :, 0], u[:, :, 1], left, np.isnan(new) != np.isnan(fixed)))
        return {
            **{c: part[c] for c in inputs}, "fixed": [np.ravel(f.T) for f in _by_block(new)], "changed": [int(c.sum()) for c in changes],
            **{n: [block[k % 3] for block in (x, b)[k // 3]] for k, n in enumerate(names[:-1])},
            "residual": [g.max(axis=0) for g in left],
        }

    now = cut_lineage(_each_block(packed, keys, inputs, alone, f"{kept}, fixed {doubles}"))
    given = [*inputs, "fixed"]
    ended = []
    for _ in range(most_rounds):
        parts = _each_block(now, keys, given, summary, f"n long, first_fixed {doubles}, last_fixed {doubles}, " + ", ".join(f"{n} {doubles}" for n in "agcpq"))
        ends = _chain(parts, keys, ["n", *shape], edges, ", ".join(f"{n} {doubles}" for n in end_names), single_rows)
        # grouped, not joined: a join's estimated size is a product, whose digits double every round
        both = now.select(*keys, "block", *given).unionByName(ends, allowMissingColumns=True)
        both = both.groupBy(*keys, "block").agg(*[F.any_value(c, F.lit(True)).alias(c) for c in (*given, *end_names)])
        out = f"{kept}, fixed {doubles}, changed long, " + ", ".join(f"{n} {doubles}" for n in names)
        solved = cut_lineage(_each_block(both, keys, [*given, *end_names], solve, out))
        moving = solved.where("changed > 0").select(*keys).distinct()
        ended.append(solved.join(moving, keys, "left_anti").select(*keys, "block", *names))
        if moving.isEmpty():
            return _rows_of(packed, reduce(DataFrame.unionByName, ended), keys, order, names)
        now = solved.join(moving, keys, "left_semi").select(*keys, "block", *given)
    raise RuntimeError(f"held biases still change after {most_rounds} rounds")


def with_transforms(corrected: DataFrame, rot_x: str, rot_y: str, azimuth: str) -> DataFrame:
    """Add ``transform``: the 4 x 4 vehicle-to-world pose of each corrected row, 16 numbers row by row."""
    turn = rotation.transpose(rotation.attitude(F.col(rot_x), F.col(rot_y), F.col(azimuth)))
    rows = [[*map(rotation.as_column, turn[i]), F.col(f"{c}_c")] for i, c in enumerate(XYZ)]
    return corrected.withColumn("transform", F.array(*[v for row in rows for v in row], *map(F.lit, (0.0, 0.0, 0.0, 1.0))))
