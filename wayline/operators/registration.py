"""Fitting and registration: normals, planes, scan alignment."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayline.operators import spatial
from wayline.session import cut_lineage


def normals(points: DataFrame, coords: Sequence[str], ident: str, k: int = 30, start: float = 0.2) -> DataFrame:
    """Unit normal (nx, ny, nz) and curvature per point from its k nearest neighbours.

    Neighbour search and covariance sums run on Spark; only the 3 x 3
    eigenproblem is solved in batches with numpy.
    """
    near = spatial.k_nearest(points, coords, ident, k, start)
    n = [f"n_{c}" for c in coords]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    cov = near.groupBy(ident).agg(
        *[(F.avg(F.col(n[i]) * F.col(n[j])) - F.avg(n[i]) * F.avg(n[j])).alias(f"s{i}{j}") for i, j in pairs]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.empty((len(b), 3, 3))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = b[f"s{i}{j}"].to_numpy()
            values, vectors = np.linalg.eigh(m)
            total = values.sum(axis=1)
            yield pd.DataFrame(
                {
                    ident: b[ident].to_numpy(),
                    **{f"n{a}": vectors[:, i, 0] for i, a in enumerate("xyz")},
                    "curvature": np.divide(values[:, 0], total, out=np.zeros(len(b)), where=total > 0),
                }
            )

    id_type = dict(points.dtypes)[ident]
    return cov.mapInPandas(solve, f"{ident} {id_type}, nx double, ny double, nz double, curvature double")


XYZ = ["x", "y", "z"]


def _three_by_three(df: DataFrame, keys: Sequence[str], fields: Sequence[str], solve, names: Sequence[str]) -> DataFrame:
    """Run ``solve`` on batches of per-group sums; one small row per group."""
    keys = list(keys)
    types = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"{n} double" for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = solve(b[list(fields)].to_numpy(float)) if len(b) else np.empty((0, len(names)))
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(got, columns=list(names))], axis=1)

    return df.select(*keys, *fields).mapInPandas(run, schema)


def _plane_of_sums(v: np.ndarray) -> np.ndarray:
    """Normal (up) and root error of planes from the sums of products of their points' offsets."""
    m = np.empty((len(v), 3, 3))
    for k, (i, j) in enumerate((i, j) for i in range(3) for j in range(i, 3)):
        m[:, i, j] = m[:, j, i] = v[:, k]
    values, vectors = np.linalg.eigh(m)
    n = vectors[:, :, 0] * np.where(vectors[:, 2:3, 0] < 0, -1.0, 1.0)
    return np.column_stack([n, np.sqrt(np.maximum(values[:, 0], 0.0))])


def fit_planes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares plane per key: normal (up), mean point, root error over n, n."""
    keys = list(keys)
    centre = points.groupBy(*keys).agg(*[F.avg(c).alias(f"p{c}") for c in XYZ], F.count("*").alias("n_fit"))
    d = points.join(centre, keys).withColumns({f"_d{c}": F.col(c) - F.col(f"p{c}") for c in XYZ})
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = d.groupBy(*keys).agg(*[F.sum(F.col(f"_d{XYZ[i]}") * F.col(f"_d{XYZ[j]}")).alias(f"_s{i}{j}") for i, j in pairs])

    normal = _three_by_three(sums, keys, [f"_s{i}{j}" for i, j in pairs], _plane_of_sums, ["nx", "ny", "nz", "_root"])
    out = normal.join(centre, keys)
    return out.withColumn("error", F.col("_root") / F.col("n_fit")).drop("_root")


#: points of a key up to which its planes are sought together with other keys
SMALL_KEY = 10_000


def _drawn_rows(hashes: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The row of the smallest hash of each group."""
    least = np.flatnonzero(hashes == np.minimum.reduceat(hashes, starts)[group])
    return least[np.searchsorted(least, starts)]


def best_planes(
    p: np.ndarray, starts: np.ndarray, hashes: Sequence[np.ndarray], threshold: float, min_points: int,
    up: Sequence[float] | None = None, least: float = 0.0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many groups of points, one behind the other, the best three-point plane, refitted to its inliers.

    ``hashes`` holds three columns a try. Returns which groups have a plane, and
    their normals, mean points with the errors, and inliers.
    """
    size = np.diff(np.r_[starts, len(p)])
    group = np.repeat(np.arange(len(starts)), size)
    most, hit = np.zeros(len(starts), np.int64), np.zeros(len(p), bool)
    for t in range(0, len(hashes), 3):
        a, b, c = (p[_drawn_rows(h, starts, group)] for h in hashes[t : t + 3])
        u, v = b - a, c - a
        normal = np.stack([u[:, 1] * v[:, 2] - u[:, 2] * v[:, 1], u[:, 2] * v[:, 0] - u[:, 0] * v[:, 2], u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]], axis=1)
        length = np.sqrt(normal[:, 0] * normal[:, 0] + normal[:, 1] * normal[:, 1] + normal[:, 2] * normal[:, 2])
        good = length > 1e-12
        normal = normal / np.where(good, length, 1.0)[:, None]
        if up is not None:
            good &= np.abs(normal[:, 0] * up[0] + normal[:, 1] * up[1] + normal[:, 2] * up[2]) >= least
        parts = (p - a[group]) * normal[group]
        near = (np.abs(parts[:, 0] + parts[:, 1] + parts[:, 2]) < threshold) & good[group]
        votes = np.add.reduceat(near.astype(np.int64), starts)
        more = votes > most
        most[more] = votes[more]
        hit = np.where(more[group], near, hit)
    found = (size >= min_points) & (most >= min(min_points, 3))
    with np.errstate(invalid="ignore", divide="ignore"):
        centre = np.add.reduceat(np.where(hit[:, None], p, 0.0), starts) / most[:, None]
    d = np.where(hit[:, None], p - centre[group], 0.0)
    sums = np.stack([np.add.reduceat(d[:, i] * d[:, j], starts) for i in range(3) for j in range(i, 3)], axis=1)[found]
    fit = _plane_of_sums(sums)
    return found, fit[:, :3], np.column_stack([centre[found], fit[:, 3] / most[found]]), most[found]


def _small_ransac_planes(
    points: DataFrame, keys: Sequence[str], ident: str, threshold: float, tries: int, min_points: int,
    up: tuple[float, float, float] | None, max_tilt_deg: float | None, seed: int,
) -> DataFrame:
    """:func:`ransac_planes` of keys of at most ``SMALL_KEY`` points: rows come sorted by key, and those of many keys are worked out together."""
    keys = list(keys)
    types = dict(points.dtypes)
    slots = [f"_h{i}_{j}" for i in range(tries) for j in range(3)]
    out = ["nx", "ny", "nz", "px", "py", "pz"]
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"{n} double" for n in out], "n_fit bigint, error double, n_inliers bigint"])
    tilted = up is not None and max_tilt_deg is not None
    least = float(np.cos(np.radians(max_tilt_deg))) if tilted else 0.0

    def planes(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        p = np.column_stack([rows.column(c).cast(pa.float64()).to_numpy() for c in XYZ])
        hashes = [rows.column(h).to_numpy() for h in slots]
        found, normal, centre, n = best_planes(p, starts, hashes, threshold, min_points, up if tilted else None, least)
        own = rows.select(keys).take(pa.array(starts[found]))
        numbers = [*normal.T, *centre[:, :3].T, n, centre[:, 3], n]
        arrays = [*[own.column(k).combine_chunks() for k in keys], *[pa.array(x) for x in numbers]]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, *out, "n_fit", "error", "n_inliers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last key so far, which may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            new = np.r_[True, np.zeros(rows.num_rows - 1, bool)]
            for k in keys:
                code = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= np.diff(code) != 0
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield planes(rows.slice(0, int(starts[-1])), starts[:-1])
            kept = rows.slice(int(starts[-1]))
        if kept is not None:
            yield planes(kept, np.zeros(1, np.int64))

    rows = points.select(*keys, ident, *XYZ).repartition(*keys).sortWithinPartitions(*keys, ident, *XYZ)
    rows = rows.select(*keys, *XYZ, *[F.xxhash64(F.lit(seed), F.lit(i), F.lit(j), *keys, ident).alias(f"_h{i}_{j}") for i in range(tries) for j in range(3)])
    return rows.mapInArrow(run, schema)


def ransac_planes(
    points: DataFrame, keys: Sequence[str], ident: str, threshold: float = 0.05, tries: int = 10, min_points: int = 10,
    up: tuple[float, float, float] | None = None, max_tilt_deg: float | None = None, seed: int = 0,
    within: tuple[DataFrame, Sequence[str]] | None = None,
) -> DataFrame:
    """Best of ``tries`` three-point planes per key, refitted to its inliers.

    The three points of a try are those with the smallest hash of (id, try,
    slot), so the draw is the same on every run. Keys of few points are worked
    out many together; of larger ones no group is gathered. ``within`` names a
    table and some of the keys whose rows there are at least a key's points, and
    spares counting ``points``. Keys with too few points or inliers drop out.
    """
    keys = list(keys)
    sized, by = within or (points, keys)
    by = list(by)
    wide = cut_lineage(sized.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL_KEY).select(*[F.col(k).alias(f"_w_{k}") for k in by]))
    if wide.isEmpty():
        return _small_ransac_planes(points, keys, ident, threshold, tries, min_points, up, max_tilt_deg, seed)
    same = [points[k].eqNullSafe(F.col(f"_w_{k}")) for k in by]
    few = _small_ransac_planes(points.join(wide, same, "left_anti"), keys, ident, threshold, tries, min_points, up, max_tilt_deg, seed)
    return few.unionByName(_large_ransac_planes(points.join(wide, same, "left_semi"), keys, ident, threshold, tries, min_points, up, max_tilt_deg, seed))


def _large_ransac_planes(
    points: DataFrame, keys: Sequence[str], ident: str, threshold: float, tries: int, min_points: int,
    up: tuple[float, float, float] | None, max_tilt_deg: float | None, seed: int,
) -> DataFrame:
    """:func:`ransac_planes` of keys of any size: draws and votes are partial aggregates."""
    keys = list(keys)

    def draw(i, j):
        return F.min_by(F.struct(*XYZ), F.xxhash64(F.lit(seed), F.lit(i), F.lit(j), *keys, ident)).alias(f"_p{i}_{j}")

    drawn = points.groupBy(*keys).agg(F.count("*").alias("_n"), *[draw(i, j) for i in range(tries) for j in range(3)]).where(
        F.col("_n") >= min_points
    )
    planes = F.array(
        *[F.struct(F.lit(i).alias("i"), *[F.col(f"_p{i}_{j}").alias(f"p{j}") for j in range(3)]) for i in range(tries)]
    )
    models = drawn.select(*keys, F.explode(planes).alias("_m"))
    a, b, c = ([F.col(f"_m.p{j}")[x] for x in XYZ] for j in range(3))
    u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    models = models.select(*keys, F.col("_m.i").alias("_i"), *[n.alias(f"_n{x}") for n, x in zip(normal, XYZ)], *[F.col("_m.p0")[x].alias(f"_q{x}") for x in XYZ])
    size = F.sqrt(sum((F.col(f"_n{x}") * F.col(f"_n{x}") for x in "yz"), F.col("_nx") * F.col("_nx")))
    models = models.withColumn("_size", size).where("_size > 1e-12").withColumns({f"_n{x}": F.col(f"_n{x}") / F.col("_size") for x in XYZ})
    if up is not None and max_tilt_deg is not None:
        cosine = F.abs(sum((F.col(f"_n{x}") * g for x, g in zip("yz", up[1:])), F.col("_nx") * up[0]))
        models = models.where(cosine >= float(np.cos(np.radians(max_tilt_deg))))
    models = models.drop("_size")
    # a key has at most ``tries`` models, so every point meets a constant number of them
    off = sum(((F.col(x) - F.col(f"_q{x}")) * F.col(f"_n{x}") for x in "yz"), (F.col("x") - F.col("_qx")) * F.col("_nx"))
    tried = points.join(models, keys).where(F.abs(off) < threshold)
    votes = tried.groupBy(*keys, "_i").agg(F.count("*").alias("n_inliers"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("n_inliers", (-F.col("_i")).alias("_neg"))).alias("_b"))
    best = best.select(*keys, (-F.col("_b._neg")).alias("_i"), F.col("_b.n_inliers").alias("n_inliers")).where(F.col("n_inliers") >= min(min_points, 3))
    inliers = points.join(best.join(models, [*keys, "_i"]), keys).where(F.abs(off) < threshold)
    planes = fit_planes(inliers.select(*keys, *XYZ), keys).join(best.drop("_i"), keys)
    return planes.select(*keys, *[f"n{c}" for c in XYZ], *[f"p{c}" for c in XYZ], "n_fit", "error", "n_inliers")


def ground_planes(
    poses: DataFrame, ground: DataFrame, keys: Sequence[str], pose: str, ident: str, radius: float = 25.0, threshold: float = 0.05, tries: int = 10, min_points: int = 10
) -> DataFrame:
    """Ground plane around each pose from the points within ``radius`` and between the outer lanes.

    ``poses`` holds x, y, z and, if the lanes are known, their distances y_left
    and y_right with the pose's sideways axis (lx, ly, lz).
    """
    from wayline.operators import spatial

    near = spatial.radius_join(poses, ground, keys, XYZ, radius, prefix="c_")
    if "y_left" in poses.columns:
        side = sum(((F.col(c) - F.col(f"c_{c}")) * F.col(f"c_l{c}") for c in "yz"), (F.col("x") - F.col("c_x")) * F.col("c_lx"))
        near = near.where((side < F.col("c_y_left")) & (side > F.col("c_y_right")))
    near = near.select(*keys, F.col(f"c_{pose}").alias(pose), ident, *XYZ)
    return ransac_planes(near, [*keys, pose], ident, threshold, tries, min_points, within=(ground, keys))


#: three points are drawn from cells of so many sizes, each half of the one before
DRAW_LEVELS = 6
#: draws that are tried together
DRAWS = 1024
#: draws of those that are refitted
GROWN = 8
#: scans of more points first rank draws by the points of their cell
LARGE_SCAN = 4096
#: points of a scan up to which it is searched together with others
SMALL_SCAN = 256
#: points of the scans that one call searches
SCANS_POINTS = 10_000


def _drawn_planes(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals and offsets of planes through three points of a cell, cells of all sizes at random places.

    Points near each other lie on one plane far more often than any three of a
    scan do, whatever share of the scan the plane has.
    """
    low = p.min(axis=0)
    extent = max(float((p.max(axis=0) - low).max()), 1e-9)
    draws, cells = [], []
    each = -(-DRAWS // DRAW_LEVELS)
    for level in range(DRAW_LEVELS):
        size = extent / 2**level
        cell = np.floor((p - low) / size + (rng.random(3) if level else 0.0)).astype(np.int64)
        code = (cell[:, 0] * 1000 + cell[:, 1]) * 1000 + cell[:, 2]
        order = np.argsort(code, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        counts = np.diff(np.r_[new, len(p)])
        group = np.searchsorted(new, rng.integers(len(p), size=each), side="right") - 1
        picks = new[group][:, None] + np.floor(rng.random((each, 3)) * counts[group][:, None]).astype(np.int64)
        draws.append(order[picks])
        if len(p) > LARGE_SCAN:
            around = new[group][:, None] + np.floor(rng.random((each, 32)) * counts[group][:, None]).astype(np.int64)
            cells.append(order[around])
    a, b, c = (p[np.concatenate(draws)[:, k]] for k in range(3))
    normal = np.cross(b - a, c - a)
    length = np.linalg.norm(normal, axis=1)
    good = length > 1e-12
    normal = normal[good] / length[good][:, None]
    offset = np.einsum("ij,ij->i", normal, a[good])
    if len(p) > LARGE_SCAN and len(normal):
        near = p[np.concatenate(cells)[good]]
        miss = np.abs(np.einsum("kij,kj->ki", near, normal) - offset[:, None])
        best = np.argsort(np.median(miss, axis=1), kind="stable")[:128]
        normal, offset = normal[best], offset[best]
    return normal, offset


def _votes(p: np.ndarray, normal: np.ndarray, offset: np.ndarray, threshold: float) -> np.ndarray:
    """Points near each plane; plain products, as threads of a matrix library only get in each other's way here."""
    off = p[:, :1] * normal[:, 0] + p[:, 1:2] * normal[:, 1] + p[:, 2:] * normal[:, 2] - offset
    return (np.abs(off) < threshold).sum(axis=0)


def _fitted(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares plane of some points: normal and mean point."""
    centre = p.mean(axis=0)
    return np.linalg.eigh((p - centre).T @ (p - centre))[1][:, 0], centre


def _grown(p: np.ndarray, normal: np.ndarray, centre: np.ndarray, threshold: float) -> tuple[int, np.ndarray, np.ndarray]:
    """A plane refitted to its points as long as that gains some; points near each other say little about a plane far off."""
    hit = np.abs((p - centre) @ normal) < threshold
    while (n := int(hit.sum())) >= 3:
        refit = _fitted(p[hit])
        again = np.abs((p - refit[1]) @ refit[0]) < threshold
        if again.sum() <= n:
            break
        normal, centre, hit = *refit, again
    return n, normal, centre


def _taken(rest: np.ndarray, normal: np.ndarray, centre: np.ndarray, threshold: float) -> tuple[tuple[np.ndarray, np.ndarray, float, int], np.ndarray]:
    """A found plane as it is given back, and the points it leaves."""
    hit = np.abs((rest - centre) @ normal) < threshold
    centre = rest[hit].mean(axis=0) - ((rest[hit].mean(axis=0) - centre) @ normal) * normal  # beside the points' mean, on the plane
    hit = np.abs((rest - centre) @ normal) < threshold
    normal = normal * (-1.0 if normal[2] < 0 else 1.0)
    error = float(np.sqrt((((rest[hit] - centre) @ normal) ** 2).sum()) / hit.sum())
    return (normal, centre, error, int(hit.sum())), rest[~hit]


def search_planes(p: np.ndarray, threshold: float, min_points: int, rng: np.random.Generator, confidence: float = 0.9999, local_share: float = 0.35) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
    """Planes of a scan one after the other: normal (up), mean point, root error over n, inliers among the points not yet explained.

    Draws go on until a plane with as many points as the best one so far (or
    with ``min_points``, as long as none has) would have been met with
    ``confidence``, if a cell at it holds ``local_share`` of its points; the scan
    is closed when that many draws show none of ``min_points``. The best draws
    are refitted to their points as long as that gains points.
    """
    found, rest = [], p
    while len(rest) >= max(min_points, 3):
        best, model, tried = 0, None, 0
        while True:
            share = max(best, min_points) / len(rest) * local_share**2 / DRAW_LEVELS
            if tried >= np.log(1 - confidence) / np.log1p(-min(share, 0.999)):
                break
            normal, offset = _drawn_planes(rest, rng)
            tried += DRAWS
            step = max(1, (1 << 22) // len(rest))
            votes = [_votes(rest, normal[at : at + step], offset[at : at + step], threshold) for at in range(0, len(normal), step)]
            for k in np.argsort(-np.concatenate([np.zeros(0, np.int64), *votes]), kind="stable")[:GROWN]:
                n, *plane = _grown(rest, normal[k], offset[k] * normal[k], threshold)
                if n > best:
                    best, model = n, plane
        if model is None or best < min_points:
            break
        plane, rest = _taken(rest, *model, threshold)
        found.append(plane)
    return found


def _drawn_together(p: np.ndarray, sizes: np.ndarray, rngs: list[np.random.Generator]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_drawn_planes` of several small scans (scan, point, axis), padded behind their ``sizes``; and which draws span a plane."""
    scans, most = p.shape[:2]
    at = np.arange(most)
    real = at < sizes[:, None]
    low = np.where(real[:, :, None], p, np.inf).min(axis=1)
    extent = np.maximum((np.where(real[:, :, None], p, -np.inf).max(axis=1) - low).max(axis=1), 1e-9)
    each = -(-DRAWS // DRAW_LEVELS)
    every = np.arange(scans)[:, None]
    draws = []
    for level in range(DRAW_LEVELS):
        shift = np.array([rng.random(3) if level else np.zeros(3) for rng in rngs])
        seen = np.array([rng.integers(n, size=each) for rng, n in zip(rngs, sizes.tolist(), strict=True)])
        share = np.array([rng.random((each, 3)) for rng in rngs])
        cell = np.floor((p - low[:, None]) / (extent / 2**level)[:, None, None] + shift[:, None]).astype(np.int64)
        code = np.where(real, (cell[:, :, 0] * 1000 + cell[:, :, 1]) * 1000 + cell[:, :, 2], np.iinfo(np.int64).max)
        order = np.argsort(code, axis=1, kind="stable")
        new = np.ones(code.shape, bool)
        new[:, 1:] = np.diff(np.take_along_axis(code, order, axis=1), axis=1) != 0
        start = np.maximum.accumulate(np.where(new, at, 0), axis=1)
        last = np.ones(code.shape, bool)
        last[:, :-1] = new[:, 1:]
        end = np.minimum.accumulate(np.where(last, at + 1, most)[:, ::-1], axis=1)[:, ::-1]
        start, end = np.take_along_axis(start, seen, axis=1), np.take_along_axis(end, seen, axis=1)
        picks = start[:, :, None] + np.floor(share * (end - start)[:, :, None]).astype(np.int64)
        draws.append(order[every[:, :, None], picks])
    picks = np.concatenate(draws, axis=1)
    a, b, c = (p[every, picks[:, :, k]] for k in range(3))
    u, v = b - a, c - a
    normal = np.stack([u[..., 1] * v[..., 2] - u[..., 2] * v[..., 1], u[..., 2] * v[..., 0] - u[..., 0] * v[..., 2], u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]], axis=2)
    length = np.sqrt((normal * normal).sum(axis=2))
    good = length > 1e-12
    normal = normal / np.where(good, length, 1.0)[:, :, None]
    return normal, (normal * a).sum(axis=2), good


def _grown_together(p: np.ndarray, real: np.ndarray, normal: np.ndarray, centre: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_grown` of a plane each of several scans."""

    def hits(rows: np.ndarray, normal: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return (np.abs(((p[rows] - centre[:, None]) * normal[:, None]).sum(axis=2)) < threshold) & real[rows]

    todo = np.arange(len(p))
    hit = hits(todo, normal, centre)
    n, normal, centre = hit.sum(axis=1), normal.copy(), centre.copy()
    while len(todo := todo[n[todo] >= 3]):
        own = np.where(hit[todo, :, None], p[todo], 0.0)
        middle = own.sum(axis=1) / n[todo, None]
        own = np.where(hit[todo, :, None], p[todo] - middle[:, None], 0.0)
        refit = np.linalg.eigh(own.transpose(0, 2, 1) @ own)[1][:, :, 0]
        again = hits(todo, refit, middle)
        gains = again.sum(axis=1) > n[todo]
        todo = todo[gains]
        hit[todo], normal[todo], centre[todo] = again[gains], refit[gains], middle[gains]
        n[todo] = hit[todo].sum(axis=1)
    return n, normal, centre


def search_planes_together(scans: list[np.ndarray], threshold: float, min_points: int, rngs: list[np.random.Generator], confidence: float = 0.9999, local_share: float = 0.35) -> list[list[tuple[np.ndarray, np.ndarray, float, int]]]:
    """:func:`search_planes` of many small scans: the same draws of each, worked out as further axes of the same steps."""
    found: list[list] = [[] for _ in scans]
    rest = list(scans)
    best, tried, models = [0] * len(scans), [0] * len(scans), [None] * len(scans)
    open_ = [k for k, q in enumerate(rest) if len(q) >= max(min_points, 3)]
    while open_:
        asked = []
        for k in open_:
            while True:
                share = max(best[k], min_points) / len(rest[k]) * local_share**2 / DRAW_LEVELS
                if tried[k] < np.log(1 - confidence) / np.log1p(-min(share, 0.999)):
                    asked.append(k)
                    break
                if models[k] is None or best[k] < min_points:
                    break
                plane, rest[k] = _taken(rest[k], *models[k], threshold)
                found[k].append(plane)
                best[k], tried[k], models[k] = 0, 0, None
                if len(rest[k]) < max(min_points, 3):
                    break
        open_ = asked
        asked.sort(key=lambda k: len(rest[k]))
        for start in range(0, len(asked), 16):
            part = asked[start : start + 16]
            sizes = np.array([len(rest[k]) for k in part])
            p = np.zeros((len(part), sizes.max(), 3))
            for row, k in enumerate(part):
                p[row, : sizes[row]] = rest[k]
            normal, offset, good = _drawn_together(p, sizes, [rngs[k] for k in part])
            votes = np.stack([_votes(p[row, :n], normal[row], offset[row], threshold) for row, n in enumerate(sizes)])
            top = np.argsort(-np.where(good, votes, -1), axis=1, kind="stable")[:, :GROWN]
            row = np.repeat(np.arange(len(part)), top.shape[1])
            col = top.reshape(-1)
            row, col = row[good[row, col]], col[good[row, col]]
            real = np.arange(p.shape[1]) < sizes[:, None]
            n, grown, centre = _grown_together(p[row], real[row], normal[row, col], offset[row, col][:, None] * normal[row, col], threshold)
            for k in part:
                tried[k] += DRAWS
            for r, count, direction, middle in zip(row.tolist(), n.tolist(), grown, centre, strict=True):
                if count > best[part[r]]:
                    best[part[r]], models[part[r]] = count, (direction, middle)
    return found


def find_planes(
    points: DataFrame, keys: Sequence[str], ident: str, threshold: float = 0.2, min_points: int = 100,
    up: tuple[float, float, float] = (0.0, 0.0, 1.0), max_tilt_deg: float = 10.0, seed: int = 0, **search,
) -> DataFrame:
    """All planes of each scan in the order of their finding: keys, ``round``, the plane, ``error``, ``n_inliers``, ``steep``.

    ``n_inliers`` counts the points nearer than ``threshold`` to the plane and to
    none before it. Planes steeper than ``max_tilt_deg`` explain their points as
    well. A scan is one turn of a sensor, of bounded size, and goes through one
    task; draws depend on its key and ``seed`` only. Points with numbers that
    are not finite are left out.
    """
    keys = list(keys)
    types = dict(points.dtypes)
    names = ["round", "nx", "ny", "nz", "px", "py", "pz", "error", "n_inliers", "steep"]
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "round bigint", *[f"{c} double" for c in names[1:8]], "n_inliers bigint, steep boolean"])
    gravity = np.asarray(up, float) / np.linalg.norm(up)
    least = float(np.cos(np.radians(max_tilt_deg)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident, kind="stable")
        key = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        heads = pdf[keys].iloc[order[starts]].to_numpy().tolist()
        scans = np.split(pdf[XYZ].to_numpy(float)[order], starts[1:])
        rngs = [np.random.default_rng(zlib.crc32(repr((seed, [str(v) for v in head])).encode())) for head in heads]
        if len(scans) == 1:
            found = [search_planes(scans[0], threshold, min_points, rngs[0], **search)]
        else:
            found = search_planes_together(scans, threshold, min_points, rngs, **search)
        rows = [[at, r, *n, *c, e, k, abs(float(n @ gravity)) < least] for at, planes in enumerate(found) for r, (n, c, e, k) in enumerate(planes)]
        out = pd.DataFrame(rows, columns=["_at", *names])
        own = pdf[keys].iloc[order[starts]].iloc[out["_at"].to_numpy(np.int64)].reset_index(drop=True)
        return pd.concat([own, out[names]], axis=1)

    # the search takes far longer than its few bytes suggest, so its tasks are not merged by size
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scans = spatial.usable(points.select(*keys, ident, *XYZ), XYZ)
    counts = scans.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    small, large = scans, None
    if (most or 0) > SMALL_SCAN:
        wide = cut_lineage(counts.where(F.col("_n") > SMALL_SCAN).select(*keys))
        same = [scans[k].eqNullSafe(F.col(f"_w_{k}")) for k in keys]
        wide = wide.select(*[F.col(k).alias(f"_w_{k}") for k in keys])
        small, large = scans.join(wide, same, "left_anti"), scans.join(wide, same, "left_semi")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-(total or 0) // SCANS_POINTS))))
    found = small.withColumn("_bucket", bucket).repartition(tasks, "_bucket").groupBy("_bucket").applyInPandas(solve, schema)
    return found if large is None else found.unionByName(large.repartition(tasks, *keys).groupBy(*keys).applyInPandas(solve, schema))


def support_planes(
    points: DataFrame, keys: Sequence[str], ident: str, threshold: float = 0.2, min_points: int = 100,
    up: tuple[float, float, float] = (0.0, 0.0, 1.0), max_tilt_deg: float = 10.0, highest: bool = False, seed: int = 0, **search,
) -> DataFrame:
    """Support plane per scan: of the planes of :func:`find_planes` that are not steep the first, or with ``highest`` the one that lies highest.

    Scans without such a plane have no row. The planes are written when this is called.
    """
    keys = list(keys)
    found = find_planes(points, keys, ident, threshold, min_points, up, max_tilt_deg, seed, **search).where("NOT steep").drop("steep")
    found = cut_lineage(found)
    height = sum((F.col(f"p{c}") * g for c, g in zip("yz", up[1:])), F.col("px") * up[0])
    rank = F.struct(height, -F.col("round")) if highest else F.struct(-F.col("round"))
    cols = [c for c in found.columns if c not in keys]
    best = found.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("_b"))
    return best.select(*keys, "_b.*")


def plane_offset():
    """Signed distance of a point (x, y, z) from the plane nx..nz through px..pz."""
    return sum(((F.col(c) - F.col(f"p{c}")) * F.col(f"n{c}") for c in "yz"), (F.col("x") - F.col("px")) * F.col("nx"))


def objects_above_plane(
    points: DataFrame, planes: DataFrame, keys: Sequence[str], ident: str, low: float, high: float, eps: float = 0.75, min_size: int = 50, max_size: int = 5000
) -> DataFrame:
    """Boxes of the clusters that stand in a height band above the plane; their lower side is put on the plane."""
    from wayline.operators import clustering

    d = points.join(planes, list(keys)).withColumn("above", plane_offset()).where(F.col("above").between(low, high))
    d = clustering.euclidean_clusters(d.select(*keys, ident, *XYZ, "above"), keys, XYZ, ident, eps, min_size, max_size)
    return d.groupBy(*keys, "cluster").agg(
        *[F.min(c).alias(f"{c}_min") for c in "xy"], *[F.max(c).alias(f"{c}_max") for c in XYZ],
        F.min(F.col("z") - F.col("above")).alias("z_min"), F.count("*").alias("n_points"),
    )


def align_chunks(
    source: DataFrame, target: DataFrame, chunk: str, ident: str, target_id: str, features: dict[str, float],
    max_dist: float, max_rounds: int = 100, tolerance: float = 0.001, final_dist: float = 0.1, median_width: float | None = None,
) -> DataFrame:
    """Rigid alignment of source chunks onto target chunks: r00..r22, tx, ty, tz and the mean error.

    All chunks go through the rounds together: nearest match in the weighted
    space, then a shift by the upper median of each axis, until every chunk
    moves less than ``tolerance``. A turn about the centre is fitted last from
    sums over the matches within ``final_dist``. ``features`` maps columns to
    their weights; x, y and z come first.
    """
    from wayline.operators import blocks, spatial
    from wayline.session import cut_lineage

    w = {c: F.col(c) * F.lit(float(k)) for c, k in features.items()}
    names = [f"w_{c}" for c in features]
    width = median_width or max_dist / 16
    tgt = cut_lineage(target.select(chunk, target_id, *[F.col(c).alias(f"t_{c}") for c in XYZ], *[w[c].alias(n) for c, n in zip(features, names)]))
    shifts = source.select(chunk).distinct().select(chunk, *[F.lit(0.0).alias(f"s{c}") for c in XYZ], F.lit(False).alias("done"))
    src = cut_lineage(source.select(chunk, ident, *features))

    def matches(moved, limit):
        weighted = moved.select(chunk, ident, *XYZ, *[(F.col(c) * F.lit(float(k))).alias(n) for (c, k), n in zip(features.items(), names)])
        near = spatial.nearest_within(weighted, tgt, [chunk], names[:3], limit, target_id, strict=False, extra=names[3:], few=0)
        return near.join(tgt.select(chunk, target_id, *[f"t_{c}" for c in XYZ]), [chunk, target_id])

    def moved_by(s):
        return src.join(s, chunk).withColumns({c: F.col(c) + F.col(f"s{c}") for c in XYZ})

    for _ in range(max_rounds):
        near = matches(moved_by(shifts).where("NOT done").drop("done"), max_dist)
        steps = near.select(chunk, *[(F.col(f"t_{c}") - F.col(c)).alias(f"d{c}") for c in XYZ])
        med = blocks.grouped_median(steps, [chunk], [f"d{c}" for c in XYZ], width, upper=True)
        small = F.greatest(*[F.abs(f"d{c}") for c in XYZ]) < tolerance
        new = shifts.join(med, chunk, "left").select(
            chunk,
            *[(F.col(f"s{c}") + F.coalesce(f"d{c}", F.lit(0.0))).alias(f"s{c}") for c in XYZ],
            (F.col("done") | F.coalesce(small, F.lit(True))).alias("done"),
        )
        shifts = cut_lineage(new)
        if shifts.where("NOT done").isEmpty():
            break
    moved = moved_by(shifts).drop("done")
    error = matches(moved, max_dist).groupBy(chunk).agg(
        F.avg(F.sqrt(spatial.dist2([F.col(c) for c in XYZ], [F.col(f"t_{c}") for c in XYZ]))).alias("error")
    )
    near = matches(moved, final_dist)
    k = near.groupBy(chunk).agg(
        *[F.avg(c).alias(f"_a{c}") for c in XYZ], *[F.avg(f"t_{c}").alias(f"_b{c}") for c in XYZ],
        *[F.avg(F.col(p) * F.col(f"t_{r}")).alias(f"_h{p}{r}") for p in XYZ for r in XYZ],
    )
    cross = [(F.col(f"_h{p}{r}") - F.col(f"_a{p}") * F.col(f"_b{r}")).alias(f"_k{p}{r}") for p in XYZ for r in XYZ]
    k = k.select(chunk, *cross, *[(F.col(f"_b{c}") - F.col(f"_a{c}")).alias(f"_m{c}") for c in XYZ])

    def rotate(v):
        u, _, vt = np.linalg.svd(v[:, :9].reshape(-1, 3, 3))
        sign = np.sign(np.linalg.det(u) * np.linalg.det(vt))
        flip = np.tile(np.eye(3), (len(v), 1, 1))
        flip[:, 2, 2] = np.where(sign == 0, 1.0, sign)
        r = vt.transpose(0, 2, 1) @ flip @ u.transpose(0, 2, 1)
        return np.column_stack([r.reshape(-1, 9), v[:, 9:]])

    r_names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    rot = _three_by_three(
        k, [chunk], [*[f"_k{p}{r}" for p in XYZ for r in XYZ], *[f"_m{c}" for c in XYZ]], rotate, [*r_names, "_mx", "_my", "_mz"]
    )
    out = shifts.join(rot, chunk, "left").join(error, chunk, "left")
    one = {f"r{i}{j}": F.coalesce(f"r{i}{j}", F.lit(1.0 if i == j else 0.0)) for i in range(3) for j in range(3)}
    return out.withColumns(one).select(
        chunk, *r_names, *[(F.col(f"s{c}") + F.coalesce(f"_m{c}", F.lit(0.0))).alias(f"t{c}") for c in XYZ], "error"
    )


def score_calibration(
    points: DataFrame, edges: DataFrame, keys: Sequence[str], focal, centre, image: tuple[int, int], angles=(0.0, 0.0, 0.0), step: float = 0.003, margin: int = 4
) -> DataFrame:
    """Edge strength under the projected points for 27 small turns about the current angles.

    ``points`` are camera-frame x, y, z; ``edges`` hold u, v, strength. Returns
    one row per candidate with ``score``, and ``accepted`` on the best one when
    at least 13 candidates beat the unchanged one, else on the unchanged one.
    """
    from itertools import product

    from wayline.functions import rotation

    turns = list(product((-1, 0, 1), repeat=3))
    # a candidate's matrix is nine numbers, worked out once and not for every point
    cells = [(i, j) for i in range(3) for j in range(3)]

    def turn(number, signs):
        m = rotation.euler_matrix([F.lit(a + step * d) for a, d in zip(angles, signs)], (0, 1, 2))
        return F.struct(F.lit(number).alias("candidate"), *[rotation.as_column(m[i][j]).cast("double").alias(f"_m{i}{j}") for i, j in cells])

    tries = F.array(*[turn(i, t) for i, t in enumerate(turns)])
    d = points.withColumn("_c", F.explode(tries)).select(*keys, *XYZ, "_c.*")
    m = [[F.col(f"_m{i}{j}") for j in range(3)] for i in range(3)]
    p = [rotation.as_column(c) for c in rotation.mat_vec(m, [F.col(c) for c in XYZ])]
    d = d.withColumns({f"_p{c}": v for c, v in zip(XYZ, p)}).where("_pz > 0")
    d = d.withColumns({n: F.rint(f * F.col(f"_p{c}") / F.col("_pz") + o).cast("bigint") for n, f, c, o in zip(("u", "v"), focal, "xy", centre)})
    d = d.where((F.col("u") > margin) & (F.col("v") > margin) & (F.col("u") < image[0] - margin) & (F.col("v") < image[1] - margin))
    # points that fall on one pixel are counted before the join; the planner does not see that each
    # became 27 rows, so without the hint it takes their counts for a small side and collects them in the driver
    d = d.groupBy(*keys, "candidate", "u", "v").agg(F.count("*").alias("_n"))
    scores = d.join(edges.hint("shuffle_merge"), [*keys, "u", "v"]).groupBy("candidate").agg(F.sum(F.col("_n") * F.col("strength")).alias("score"))
    every = points.sparkSession.range(len(turns)).select(F.col("id").cast("int").alias("candidate"))
    scores = every.join(scores, "candidate", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    unchanged = turns.index((0, 0, 0))
    pick = scores.agg(
        F.max(F.when(F.col("candidate") == unchanged, F.col("score"))).alias("_now"),
        F.max(F.struct("score", (-F.col("candidate")).alias("neg"))).alias("_best"),
        F.array_agg("score").alias("_all"),  # 27 numbers
    )
    better = F.size(F.filter("_all", lambda s: s > F.col("_now")))
    chosen = pick.select(F.when(better >= len(turns) // 2, -F.col("_best.neg")).otherwise(F.lit(unchanged)).alias("_pick"))
    return scores.join(F.broadcast(chosen)).select("candidate", "score", (F.col("candidate") == F.col("_pick")).alias("accepted"))


def colour_points(
    points: DataFrame, frames: DataFrame, pixels: DataFrame, keys: Sequence[str], ident: str, point_frame: str, frame: str,
    window: int, to_pixel, first_wins: bool = False,
) -> DataFrame:
    """Colour of each point from the frames that see it in the ``window`` frames before its own; null if none.

    ``to_pixel(df)`` adds whole-number u, v to (point, frame) rows and drops
    hidden ones. The last frame wins, or the first. The pixels of many frames are
    never broadcast: made from a small table, they would look small to the planner.
    """
    from wayline.operators import timejoin

    keys = list(keys)
    pairs = timejoin.window_join(points, frames, keys, point_frame, frame, window - 1, -1)
    seen = to_pixel(pairs).join(pixels.hint("shuffle_merge"), [*keys, frame, "u", "v"])
    pick = F.min_by if first_wins else F.max_by
    colour = seen.groupBy(*keys, ident).agg(pick(F.struct("r", "g", "b"), frame).alias("_c"))
    out = points.join(colour, [*keys, ident], "left")
    return out.select(*points.columns, *[F.col("_c")[c].alias(c) for c in ("r", "g", "b")])
