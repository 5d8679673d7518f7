"""Symmetric banded systems along an order, exact on runs of any length whatever the blocks.

Two rows are taken as one, so a system with up to two bands on each side is
block tridiagonal with 2 x 2 blocks. Each block of rows is reduced to what its
last pair of rows sees of the pair before the block; these ends are chained
along the run, which is short, and the rows between follow from them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wayline.operators.smoothing import _apply, _axes, _by_block, _chain, _each_block, _flat, _inverse, _packed, _rows_of, _t


def _pairs(part, systems: Mapping[str, tuple[str, str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal blocks (pairs, systems, 2, 2), couplings with the pair before (same shape), right-hand sides (pairs, systems, 2)."""
    diag, one, two, rhs = (_axes(part, [s[k] for s in systems.values()]) for k in range(4))
    if len(diag) % 2:  # a run's odd last row gets a partner of its own
        diag, one, two, rhs = (np.concatenate([x, np.full((1, x.shape[1]), fill)]) for x, fill in ((diag, 1.0), (one, 0.0), (two, 0.0), (rhs, 0.0)))
    d = np.zeros((len(diag) // 2, diag.shape[1], 2, 2))
    up = np.zeros_like(d)
    d[..., 0, 0], d[..., 1, 1] = diag[::2], diag[1::2]
    d[..., 0, 1] = d[..., 1, 0] = one[1::2]
    up[..., 0, 0], up[..., 1, 0], up[..., 1, 1] = two[::2], one[::2], two[1::2]
    return d, up, np.stack([rhs[::2], rhs[1::2]], axis=-1)


def _inside(d: np.ndarray, up: np.ndarray, r: np.ndarray) -> np.ndarray:
    """All pairs but the last as ``x0 - X1 left - X2 right``: (pairs - 1, systems, 2, 1 + 2 + 2)."""
    n = len(d) - 1
    k = np.zeros((n, *r.shape[1:], 5))
    k[..., 0] = r[:-1]
    k[0, ..., 1:3] = _t(up[0])
    k[-1, ..., 3:5] = up[n]
    s = d[:-1].copy()
    for j in range(1, n):
        w = _t(up[j]) @ _inverse(s[j - 1])
        s[j] -= w @ up[j]
        k[j] -= w @ k[j - 1]
    inverse = _inverse(s)
    k[-1] = inverse[-1] @ k[-1]
    for j in range(n - 2, -1, -1):
        k[j] = inverse[j] @ (k[j] - up[j + 1] @ k[j + 1])
    return k


def _summary(d: np.ndarray, up: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """The block's equations in its last pair (``right``) and the pair before the block (``left``)."""
    if len(d) == 1:
        zero = np.zeros_like(d[0])
        return {"right": d[0], "rhs": r[0], "link": up[0], "left": zero, "left_rhs": np.zeros_like(r[0])}
    x = _inside(d, up, r)
    return {
        "right": d[-1] - _t(up[-1]) @ x[-1, ..., 3:5], "rhs": r[-1] - _apply(_t(up[-1]), x[-1, ..., 0]),
        "link": -up[0] @ x[0, ..., 3:5], "left": -up[0] @ x[0, ..., 1:3], "left_rhs": -_apply(up[0], x[0, ..., 0]),
    }


def _ends(parts: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
    """Last pair of every block of a run."""
    d = [p["right"] + (q["left"] if q else 0) for p, q in zip(parts, [*parts[1:], None], strict=True)]
    r = [p["rhs"] + (q["left_rhs"] if q else 0) for p, q in zip(parts, [*parts[1:], None], strict=True)]
    for j in range(1, len(d)):
        w = _t(parts[j]["link"]) @ _inverse(d[j - 1])
        d[j] = d[j] - w @ parts[j]["link"]
        r[j] = r[j] - _apply(w, r[j - 1])
    out = [r[-1]] * len(d)
    out[-1] = _apply(_inverse(d[-1]), r[-1])
    for j in range(len(d) - 2, -1, -1):
        out[j] = _apply(_inverse(d[j]), r[j] - _apply(parts[j + 1]["link"], out[j + 1]))
    return out


def solve_banded(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], systems: Mapping[str, tuple[str, str, str, str]], width: float, block_rows: int = 4096
) -> DataFrame:
    """Solutions of symmetric positive definite systems, one column per name of ``systems``: keys, order and these.

    A system names four columns: a row's diagonal, its coupling with the row
    before and with the one before that (0 at the begin), and its right-hand side.
    Rows are cut into blocks of ``block_rows``; a run's blocks are chained by one
    small row each. A missing number makes its run's solution nan. Writes the
    blocks when called.
    """
    keys, order, names = list(keys), list(order), list(systems)
    block_rows += block_rows % 2
    given = list(dict.fromkeys(c for s in systems.values() for c in s))
    columns = [f"band{i}" for i in range(len(given))]
    systems = {n: tuple(columns[given.index(c)] for c in s) for n, s in systems.items()}
    named = df.select(*keys, *order, *[F.col(c).alias(b) for c, b in zip(given, columns, strict=True)])
    packed = _packed(named, keys, order, columns, width, block_rows)
    fields = ["right", "rhs", "link", "left", "left_rhs"]
    lists = ", ".join(f"{f} array<double>" for f in fields)
    q = len(names)
    shapes = {f: (-1, 2) if "rhs" in f else (-1, 2, 2) for f in fields}

    def rows_of(block) -> tuple:
        return (len(getattr(block, columns[0])),)

    def summary(part):
        count = len(part["block"])
        return {f: _flat(x, count) for f, x in _summary(*_pairs(part, systems)).items()}

    def chain(runs, n):
        count = len(runs["rhs"][0])
        ends = _ends([{f: runs[f][at].reshape(s) for f, s in shapes.items()} for at in range(n)])
        return {"before": [_flat(e, count) for e in (np.zeros((q * count, 2)), *ends[:-1])], "last": [_flat(e, count) for e in ends]}

    def solve(part):
        d, up, r = _pairs(part, systems)
        before, last = part["before"].reshape(-1, 2), part["last"].reshape(-1, 2)
        x = np.empty_like(r)
        x[-1] = last
        if len(d) > 1:
            k = _inside(d, up, r)
            x[:-1] = k[..., 0] - _apply(k[..., 1:3], before) - _apply(k[..., 3:5], last)
        rows = np.swapaxes(x, 1, 2).reshape(-1, x.shape[1])[: part[columns[0]].shape[1]]
        solved = _by_block(rows, q)
        return {n: [block[i] for block in solved] for i, n in enumerate(names)}

    parts = _each_block(packed, keys, columns, summary, lists, rows_of)
    ends = _chain(parts, keys, fields, chain, "before array<double>, last array<double>")
    solved = _each_block(packed.join(ends, [*keys, "block"]), keys, [*columns, "before", "last"], solve, ", ".join(f"{n} array<double>" for n in names), rows_of)
    return _rows_of(packed, solved, keys, order, names)
