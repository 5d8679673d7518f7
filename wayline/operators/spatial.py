"""Spatial joins on grid cells: nearest neighbour, radius and k nearest.

Space is cut into cells, and a search becomes an equi-join on (key, cell) with
the cells in reach of each probe. Equal positions are merged before any join. Where
only the nearest is asked for, small cells are searched first and only probes
that find nothing go on to larger ones, so dense places never form all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.session import cut_lineage


def cell_names(coords: Sequence[str]) -> list[str]:
    return [f"_cell_{c}" for c in coords]


def with_cell(df: DataFrame, coords: Sequence[str], size: float) -> DataFrame:
    return df.withColumns({n: F.floor(F.col(c) / F.lit(float(size))) for n, c in zip(cell_names(coords), coords)})


def with_cells_in_reach(df: DataFrame, coords: Sequence[str], size: float, radius: float) -> DataFrame:
    """One row per cell that a box of ``radius`` around the row touches.

    With cells of twice the radius these are two per axis: 8 probes in space,
    where cells of one radius would need 27.
    """
    out = df
    for n, c in zip(cell_names(coords), coords):
        low, high = (F.floor(e / F.lit(float(size))) for e in (F.col(c) - radius, F.col(c) + radius))
        out = out.withColumn(n, F.explode(F.sequence(low, high)))
    return out


def dist2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = None
    for x, y in zip(a, b):
        d = x - y
        total = d * d if total is None else total + d * d
    return total


def nearest_within(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    coords: Sequence[str],
    tolerance: float,
    target_id: str,
    levels: Sequence[int] = (8, 1),
    strict: bool = True,
    extra: Sequence[str] = (),
    few: int = 64,
    place: str | None = None,
) -> DataFrame:
    """Nearest target of every source row, if nearer than ``tolerance``: columns target_id and ``dist``.

    Keys with up to ``few`` targets are compared directly, a list of so many
    beside each source row; the rest goes through cells. With ``place``, the
    target's coordinates are added under names with that prefix.

    Exact: all targets within the radius of a level lie in the cells the probe
    looks at, so a hit within that radius is the nearest one overall. Ties go to
    the smallest target id. ``extra`` columns count in the distance but not in
    the grid, which stays exact, as the distance can only grow by them.
    """
    keys, grid = list(keys), list(coords)
    coords = [*grid, *extra]
    if not keys or not few:
        return _nearest_in_cells(source, target, keys, grid, tolerance, target_id, levels, strict, extra, place)
    counts = target.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = target.select(*keys, *coords, target_id)
    lists = rows.join(counts.where(F.col("_n") <= few), keys).groupBy(*keys).agg(F.collect_list(F.struct(target_id, *coords)).alias("_few"))
    asked = source.join(lists.hint("shuffle_merge"), keys, "left")
    d2 = F.transform("_few", lambda t: F.struct(dist2([F.col(c) for c in coords], [t[c] for c in coords]).alias("_d2"), t[target_id].alias("_t"), *[t[c].alias(f"_t_{c}") for c in coords]))
    limit = float(tolerance) * float(tolerance)
    near = F.filter(d2, lambda t: t["_d2"] < limit if strict else t["_d2"] <= limit)
    rest = [c for c in source.columns if c not in (*keys, *coords)]
    direct = asked.where("_few IS NOT NULL").withColumn("_best", F.array_min(near)).where("_best IS NOT NULL")
    at = [] if place is None else [F.col("_best")[f"_t_{c}"].alias(place + c) for c in coords]
    direct = direct.select(*keys, *coords, *rest, F.col("_best._t").alias(target_id), F.sqrt("_best._d2").alias("dist"), *at)
    crowded = rows.join(counts.where(F.col("_n") > few).select(*keys), keys, "left_semi")
    rest = asked.where("_few IS NULL").drop("_few")
    return direct.unionByName(_nearest_in_cells(rest, crowded, keys, grid, tolerance, target_id, levels, strict, extra, place))


def _nearest_in_cells(
    source: DataFrame, target: DataFrame, keys: list[str], grid: list[str], tolerance: float, target_id: str,
    levels: Sequence[int], strict: bool, extra: Sequence[str], place: str | None,
) -> DataFrame:
    """:func:`nearest_within` on cells only."""
    names = cell_names(grid)
    coords = [*grid, *extra]
    t_names = [f"_t_{c}" for c in coords]
    places = target.groupBy(*keys, *coords).agg(F.min(target_id).alias(target_id))
    open_ = source.select(*keys, *coords).distinct()
    found = None
    for i, level in enumerate(levels):
        size = tolerance / level
        cells = with_cell(places, grid, 2 * size).select(
            *keys, *names, target_id, *[F.col(c).alias(t) for c, t in zip(coords, t_names)]
        )
        probes = with_cells_in_reach(open_, grid, 2 * size, size)
        d2 = dist2([F.col(c) for c in coords], [F.col(t) for t in t_names])
        last = i == len(levels) - 1
        near = F.col("_d2") < size * size if last and strict else F.col("_d2") <= size * size
        hit = (
            probes.join(cells, [*keys, *names])
            .withColumn("_d2", d2)
            .where(near)
            .groupBy(*keys, *coords)
            .agg(F.min(F.struct("_d2", target_id, *(t_names if place is not None else ()))).alias("_best"))
        )
        found = hit if found is None else found.unionByName(hit)
        if not last:
            open_ = open_.join(hit, [*keys, *coords], "left_anti")
    at = [] if place is None else [F.col("_best")[t].alias(place + c) for c, t in zip(coords, t_names)]
    best = found.select(*keys, *coords, F.col("_best")[target_id].alias(target_id), F.sqrt(F.col("_best._d2")).alias("dist"), *at)
    return source.join(best, [*keys, *coords])


def _leaves(places: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """Rows of ``places`` in groups of up to ``most`` that lie together: halves along the widest axis, and again."""
    out, todo = [], [np.arange(len(places))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        inside = places[rows]
        axis = int(np.argmax(inside.max(axis=0) - inside.min(axis=0)))
        cut = np.argpartition(inside[:, axis], len(rows) // 2)
        todo += [rows[cut[: len(rows) // 2]], rows[cut[len(rows) // 2 :]]]
    return out


def nearest_rows(source: np.ndarray, target: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of the nearest target of each source row (-1 without any) and the squared distance; ties go to the smallest id.

    Equal places are merged, and groups of sources look only at groups of
    targets whose bounding boxes come as near as what was found in the nearest.
    """
    found, d2 = np.full(len(source), -1), np.full(len(source), np.inf)
    order = np.flatnonzero(np.isfinite(target).all(axis=1))
    asked = np.flatnonzero(np.isfinite(source).all(axis=1))
    if not len(order) or not len(asked):
        return found, d2
    order = order[np.lexsort((order, ids[order], *target[order].T))]
    order = order[np.r_[True, (np.diff(target[order], axis=0) != 0).any(axis=1)]]
    order = order[np.argsort(ids[order], kind="stable")]
    places = target[order]

    def nearest_to(rows: np.ndarray, among: np.ndarray) -> None:
        total = 0.0
        for c in range(source.shape[1]):
            step = source[rows, None, c] - places[None, among, c]
            total = total + step * step
        best = total.argmin(axis=1)
        found[rows], d2[rows] = order[among[best]], total[np.arange(len(rows)), best]

    if len(asked) * len(order) <= 1 << 14:
        nearest_to(asked, np.arange(len(order)))
        return found, d2
    groups = _leaves(places)
    low, high = (np.array([f(places[g], axis=0) for g in groups]) for f in (np.min, np.max))
    for rows in _leaves(source[asked]):
        rows = asked[rows]
        inside = source[rows]
        step = np.maximum(np.maximum(low - inside.max(axis=0), inside.min(axis=0) - high), 0.0)
        gap = 0.0
        for c in range(source.shape[1]):
            gap = gap + step[:, c] * step[:, c]
        nearest_to(rows, np.sort(groups[int(gap.argmin())]))
        nearest_to(rows, np.sort(np.concatenate([groups[g] for g in np.flatnonzero(gap <= d2[rows].max())])))
    return found, d2


def usable(df: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Rows whose coordinates are all finite numbers; null, nan and infinite ones have no place."""
    out = df
    for c in coords:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out


def nearest(
    source: DataFrame, target: DataFrame, keys: Sequence[str], coords: Sequence[str], first: float, target_id: str,
    levels: Sequence[int] = (64, 8, 1), extra: Sequence[str] = (), few: int = 64,
) -> DataFrame:
    """Nearest target of every source row at any distance: columns target_id and ``dist``.

    Keys with up to ``few`` places of targets are compared directly, at most that
    many pairs a row. In crowded keys the search goes within ``first`` and, for
    the few places still open, within 64 times as far, until none is open; a key's
    own extent bounds it. Rows whose key has no usable target, or whose own
    coordinates are not finite, drop out. Each step is written when this is called.
    """
    keys, every = list(keys), [*keys, *coords, *extra]
    full = [*coords, *extra]
    targets = cut_lineage(usable(target.select(*every, target_id), full).groupBy(*every).agg(F.min(target_id).alias(target_id)))
    extent = targets.groupBy(*keys).agg(F.count("*").alias("_n"), *[f(c).alias(n + c) for c in full for f, n in ((F.min, "_lo_"), (F.max, "_hi_"))])
    places = usable(source.select(*every).distinct(), full)
    places = cut_lineage(places.join(extent, keys) if keys else places.crossJoin(F.broadcast(extent)))  # one row without keys
    found, crowded = None, places
    if keys:
        # a list beside each place: pairs as rows would have to be sorted to find the nearest
        listed = targets.join(extent.where(F.col("_n") <= few).select(*keys), keys, "left_semi")
        lists = listed.groupBy(*keys).agg(F.collect_list(F.struct(target_id, *full)).alias("_few"))
        asked = places.where(F.col("_n") <= few).select(*every).join(lists.hint("shuffle_merge"), keys)
        d2 = F.transform("_few", lambda t: F.struct(dist2([F.col(c) for c in full], [t[c] for c in full]).alias("_d2"), t[target_id].alias("_t")))
        best = asked.select(*every, F.array_min(d2).alias("_b"))
        found = cut_lineage(best.select(*every, F.col("_b._t").alias(target_id), F.sqrt("_b._d2").alias("dist")))
        crowded = places.where(F.col("_n") > few)
    farthest = dist2([F.greatest(F.abs(F.col(c) - F.col("_lo_" + c)), F.abs(F.col(c) - F.col("_hi_" + c))) for c in full], [F.lit(0.0)] * len(full))
    reach, limit = float(first), crowded.agg(F.max(F.sqrt(farthest))).first()[0]
    open_ = crowded.select(*every)
    while limit is not None:
        hit = cut_lineage(nearest_within(open_, targets, keys, coords, reach, target_id, levels, strict=False, extra=extra, few=0))
        found = hit if found is None else found.unionByName(hit)
        open_ = cut_lineage(open_.join(hit.select(*every), every, "left_anti"))
        if open_.isEmpty():
            break
        if reach > 2 * limit:
            raise RuntimeError(f"no target within {reach}, though all lie within {limit}")
        reach, levels = reach * 64, (8, 1)
    if found is None:
        found = targets.select(*every, target_id, F.lit(0.0).alias("dist")).limit(0)
    return source.join(found, every)


def radius_join(
    centres: DataFrame, points: DataFrame, keys: Sequence[str], coords: Sequence[str], radius: float, prefix: str = "c_"
) -> DataFrame:
    """All points within ``radius`` of each centre; the centre's columns get ``prefix``, ``dist`` is added.

    The result holds every pair in range, so it is as large as the question;
    aggregate it right away where only a summary is needed.
    """
    keys, coords = list(keys), list(coords)
    names = cell_names(coords)
    probes = with_cells_in_reach(centres, coords, 2 * radius, radius)
    probes = probes.select(*keys, *names, *[F.col(c).alias(prefix + c) for c in centres.columns if c not in keys])
    cells = with_cell(points, coords, 2 * radius)
    d2 = dist2([F.col(prefix + c) for c in coords], [F.col(c) for c in coords])
    return (
        probes.join(cells, [*keys, *names]).withColumn("dist", F.sqrt(d2)).where(F.col("dist") <= radius).drop(*names)
    )


def search_sizes(places: DataFrame, coords: Sequence[str], start: float, crowd: int) -> DataFrame:
    """``places`` with ``_size``: half the edge of the cell in which a place has at most ``crowd`` others, ``start`` at most.

    Cells with more places are cut along each axis, into the more parts the more
    crowded the fullest is, and only their places are counted again; cells of
    places that doubles cannot tell apart stay as they are.
    """
    names, size, done = cell_names(coords), float(start), None
    open_ = places
    while True:
        cells = with_cell(open_, coords, 2 * size)
        counts = cut_lineage(cells.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd))
        full, most = counts.drop("_n"), counts.agg(F.max("_n")).first()[0]
        settled = cells.join(full, names, "left_anti").drop(*names).withColumn("_size", F.lit(size))
        last = size < start * 2.0**-50
        if most is None or last:
            settled = open_.withColumn("_size", F.lit(size))
            return settled if done is None else done.unionByName(settled)
        done = settled if done is None else done.unionByName(settled)
        open_ = cut_lineage(cells.join(full, names, "left_semi").drop(*names))
        size /= 2.0 ** max(1, math.ceil(math.log2(most / crowd) / 2))


def k_nearest(points: DataFrame, coords: Sequence[str], ident: str, k: int, start: float, crowd: int = 64) -> DataFrame:
    """The k nearest points of each point (itself included): ident, ``rank`` and the neighbour's ``n_<coord>``.

    Equal distances go by ident. Points at one place share one search, and only
    its k smallest idents can be anyone's neighbours. Radii follow the density: a
    place begins with half the cell in which it has at most ``crowd`` others
    (``start`` at most) and doubles the radius until it holds k neighbours, so
    the pairs per place stay near k. The last radius covers the whole extent.
    Points with coordinates that are not finite are left out.
    """
    coords = list(coords)
    names, n_names = cell_names(coords), [f"n_{c}" for c in coords]
    rows = cut_lineage(usable(points.select(ident, *coords), coords))
    first = F.row_number().over(W.partitionBy(*coords).orderBy(ident))
    members = cut_lineage(rows.withColumn("_r", first).where(F.col("_r") <= k))
    places = cut_lineage(search_sizes(members.where("_r = 1").select(*coords), coords, start, crowd))
    extent, total, size = (
        members.select(F.greatest(*[F.max(c) - F.min(c) for c in coords], F.lit(0.0)), F.count("*")).first() + places.agg(F.min("_size")).first()
    )
    open_, done = places, None
    while size is not None:
        whole = size > (extent or 0.0) * len(coords)
        cells = with_cell(members, coords, 2 * size).select(*names, F.col(ident).alias("_n"), *[F.col(c).alias(n) for c, n in zip(coords, n_names)])
        d2 = dist2([F.col(c) for c in coords], [F.col(n) for n in n_names])
        now = open_ if whole else open_.where(F.col("_size") <= size)
        near = (
            with_cells_in_reach(now, coords, 2 * size, size)
            .join(cells, names)
            .withColumn("_d2", d2)
            .where(F.col("_d2") <= size * size)
            .withColumn("rank", F.row_number().over(W.partitionBy(*coords).orderBy("_d2", "_n")))
            .where(F.col("rank") <= k)
        )
        enough = near if whole else near.withColumn("_found", F.max("rank").over(W.partitionBy(*coords))).where(F.col("_found") == min(k, total))
        hit = cut_lineage(enough.select(*coords, "rank", *n_names))
        done = hit if done is None else done.unionByName(hit)
        if whole:
            break
        open_ = cut_lineage(open_.join(hit.where("rank = 1").select(*coords), coords, "left_anti"))
        # on to the smallest radius for which a place is due
        following = open_.agg(F.min("_size")).first()[0]
        size = None if following is None else max(2 * size, following)
    if done is None:
        return rows.limit(0).select(ident, F.lit(1).alias("rank"), *[F.col(c).alias(n) for c, n in zip(coords, n_names)])
    return rows.join(done, coords).select(ident, "rank", *n_names)
