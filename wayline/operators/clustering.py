"""Clusters of points: density and single-link clustering on a grid, and connected components."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wayline.operators import blocks, spatial
from wayline.session import cut_lineage

#: points of a key up to which it is compared whole, many keys in a task
FEW = 256
#: points that one task takes of such keys
BUCKET = 50_000

def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node on an edge.

    Alternating large-star and small-star rounds: the number of rounds grows
    with the logarithm of the graph, not with the length of a chain. Each round
    is written to the checkpoint folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = (
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut_lineage(small)
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def clusters_of_keys(ids: np.ndarray, places: np.ndarray, eps: float, min_points: int) -> tuple[np.ndarray, np.ndarray]:
    """Density clustering of keys of as many points each: ``cluster`` and whether a point is in one.

    ``ids`` is (keys, points), ``places`` (keys, points, axes). Labels spread
    from core point to core point until none changes.
    """
    n = ids.shape[1]
    d2 = 0.0
    for c in range(places.shape[2]):
        step = places[:, :, None, c] - places[:, None, :, c]
        d2 = d2 + step * step
    near = d2 <= eps * eps
    core = near.sum(axis=2) >= min_points
    order = np.argsort(ids, axis=1, kind="stable")
    rank = np.empty(ids.shape, np.int32)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n, dtype=np.int32), ids.shape), axis=1)
    label = np.where(core, rank, n)
    while True:
        spread = np.where(near, label[:, None, :], n).min(axis=2)
        spread = np.where(core, spread, n)
        # the label's own label: chains are halved, not walked
        after = np.minimum(spread, np.take_along_axis(np.append(np.take_along_axis(spread, order, axis=1), np.full((len(ids), 1), n), axis=1), spread, axis=1))
        if (after == label).all():
            break
        label = after
    joined = np.where(core, label, np.where(near, label[:, None, :], n).min(axis=2))
    named = np.take_along_axis(ids, np.take_along_axis(order, np.minimum(joined, n - 1), axis=1), axis=1)
    return named, joined < n


def _whole_keys(points: DataFrame, keys: Sequence[str], coords: Sequence[str], ident: str, eps: float, min_points: int, tasks: int) -> DataFrame:
    """:func:`density_clusters` of keys of few points, many in a task."""
    out = T.StructType([*points.schema.fields, T.StructField("cluster", points.schema[ident].dataType)])

    def solve(table: pa.Table) -> pa.Table:
        pdf = table.select([*keys, ident]).to_pandas()
        key = pdf.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
        ids = table.column(ident).to_numpy()
        places = np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in coords], axis=1)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        sizes = np.diff(np.r_[first, len(key)])
        cluster, inside = ids.copy(), np.zeros(len(ids), bool)
        for n in np.unique(sizes):
            starts = first[sizes == n]
            step = max(1, (1 << 20) // int(n * n))
            for at in range(0, len(starts), step):
                rows = order[starts[at : at + step, None] + np.arange(n)]
                cluster[rows], inside[rows] = clusters_of_keys(ids[rows], places[rows], eps, min_points)
        named = pa.array(cluster, table.schema.field(ident).type)
        return table.drop_columns(["_bucket"]).append_column("cluster", named).filter(pa.array(inside))

    bucket = F.pmod(F.xxhash64(*keys), F.lit(tasks))
    usable = points.where(F.col(ident).isNotNull())
    for c in [*keys, *coords]:
        usable = usable.where(F.col(c).isNotNull())
    return usable.withColumn("_bucket", bucket).groupBy("_bucket").applyInArrow(solve, out)


def density_clusters(
    points: DataFrame, keys: Sequence[str], coords: Sequence[str], ident: str, eps: float, min_points: int, few: int = FEW
) -> DataFrame:
    """Density clustering with noise dropped; ``cluster`` is the smallest id of a core point in it.

    Keys of up to ``few`` points are compared whole, many in a task; those of
    more points go by cells. Ids of such keys are whole numbers.
    """
    keys = list(keys)
    if not keys or not few or not isinstance(points.schema[ident].dataType, T.IntegralType):
        return _clusters_by_cells(points, keys, coords, ident, eps, min_points)
    counts = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    tasks = max(1, -(-(total or 0) // BUCKET))
    if (most or 0) <= few:
        return _whole_keys(points, keys, coords, ident, eps, min_points, tasks)
    crowded = cut_lineage(counts.where(F.col("_n") > few).select(*keys))
    small = _whole_keys(points.join(crowded, keys, "left_anti").select(*points.columns), keys, coords, ident, eps, min_points, tasks)
    large = points.join(crowded, keys, "left_semi").select(*points.columns)
    return small.unionByName(_clusters_by_cells(large, keys, coords, ident, eps, min_points))


def _clusters_by_cells(
    points: DataFrame, keys: Sequence[str], coords: Sequence[str], ident: str, eps: float, min_points: int
) -> DataFrame:
    """:func:`density_clusters` of keys of any size.

    Cells are small enough that all points of one lie within ``eps``. A crowded
    cell (at least ``min_points``, and 16) is core as a whole and forms no pairs
    inside; only points of thinner cells look at single neighbours. Crowded
    cells are then linked by the distance of their bounding boxes, and by points
    only where the boxes leave it open. Components are found on cells, not on
    points. A border point joins the smallest core cluster within reach.
    """
    keys, coords = list(keys), list(coords)
    side = eps / math.sqrt(len(coords))
    names = spatial.cell_names(coords)
    crowd = max(min_points, 16)
    places = spatial.with_cell(points.groupBy(*keys, *coords).agg(F.min(ident).alias("_id"), F.count("*").alias("_n")), coords, side)
    sizes = places.groupBy(*keys, *names).agg(F.sum("_n").alias("_cell_n"))
    places = cut_lineage(places.join(sizes, [*keys, *names]))
    dense = places.where(F.col("_cell_n") >= crowd)
    thin = places.where(F.col("_cell_n") < crowd)

    # single neighbours of points in thin cells
    q_names = [f"_q_{c}" for c in coords]
    probes = spatial.with_cells_in_reach(thin.select(*keys, "_id", *coords), coords, 2 * eps, eps)
    seen = spatial.with_cell(places.select(*keys, "_id", "_n", *coords), coords, 2 * eps)
    seen = seen.select(*keys, *names, F.col("_id").alias("_q"), F.col("_n").alias("_qn"), *[F.col(c).alias(n) for c, n in zip(coords, q_names)])
    d2 = spatial.dist2([F.col(c) for c in coords], [F.col(n) for n in q_names])
    near = cut_lineage(probes.join(seen, [*keys, *names]).where(d2 <= eps * eps).select(*keys, "_id", "_q", "_qn"))
    thin_core = near.groupBy(*keys, "_id").agg(F.sum("_qn").alias("_reach")).where(F.col("_reach") >= min_points).select(*keys, "_id")
    core = dense.unionByName(thin.join(thin_core, [*keys, "_id"], "left_semi").select(*dense.columns))
    nodes = core.groupBy(*keys, *names).agg(F.min("_id").alias("_node"))
    core = cut_lineage(core.join(nodes, [*keys, *names]).select(*keys, "_id", "_node", "_cell_n", *coords, *names))

    of = core.select(*keys, "_id", "_node")
    thin_links = (
        near.join(of.select(*keys, "_id", F.col("_node").alias("a")), [*keys, "_id"])
        .join(of.select(*keys, F.col("_id").alias("_q"), F.col("_node").alias("b")), [*keys, "_q"])
        .select("a", "b")
    )
    links = thin_links.unionByName(_dense_links(core.where(F.col("_cell_n") >= crowd), keys, coords, side, eps))
    roots = connected_components(links.where("a <> b"))
    labelled = core.join(roots, core["_node"] == roots["node"], "left").select(*keys, "_id", F.coalesce("root", "_node").alias("cluster"))
    labelled = cut_lineage(labelled)
    border = (
        near.join(labelled.select(*keys, F.col("_id").alias("_q"), "cluster"), [*keys, "_q"])
        .join(labelled.select(*keys, "_id"), [*keys, "_id"], "left_anti")
        .groupBy(*keys, "_id")
        .agg(F.min("cluster").alias("cluster"))
    )
    by_place = places.select(*keys, *coords, "_id").join(labelled.unionByName(border), [*keys, "_id"]).drop("_id")
    return points.join(by_place, [*keys, *coords])


def _boxes(df: DataFrame, group: Sequence[str], coords: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(*[f(c).alias(f"{c}_{n}") for c in coords for n, f in (("lo", F.min), ("hi", F.max))])


def _box_gap(coords: Sequence[str], p: str, q: str) -> tuple[Column, Column]:
    """Squared least and greatest distance of two bounding boxes."""
    least, most = F.lit(0.0), F.lit(0.0)
    for c in coords:
        lo_p, hi_p, lo_q, hi_q = F.col(f"{p}{c}_lo"), F.col(f"{p}{c}_hi"), F.col(f"{q}{c}_lo"), F.col(f"{q}{c}_hi")
        gap = F.greatest(lo_q - hi_p, lo_p - hi_q, F.lit(0.0))
        span = F.greatest(hi_q - lo_p, hi_p - lo_q)
        least, most = least + gap * gap, most + span * span
    return least, most


def _dense_links(core: DataFrame, keys, coords, side: float, eps: float, parts: int = 4) -> DataFrame:
    """Pairs of neighbouring dense cells that hold points within ``eps`` of each other."""
    keys, coords = list(keys), list(coords)
    names = spatial.cell_names(coords)
    limit = eps * eps

    def prefixed(df, prefix):
        return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])

    cells = _boxes(core, [*keys, *names, "_node"], coords)
    left = prefixed(cells, "p_")
    for n in names:
        left = left.withColumn("q_" + n, F.explode(F.sequence(F.col("p_" + n) - 2, F.col("p_" + n) + 2)))

    def place(p):
        return F.struct(*[F.col(p + n).alias(n) for n in names])

    left = left.where(place("q_") > place("p_"))  # each pair of cells once
    pairs = left.join(prefixed(cells, "q_"), [*keys, *["q_" + n for n in names]])
    least, most = _box_gap(coords, "p_", "q_")
    pairs = cut_lineage(
        pairs.select(*keys, F.col("p__node").alias("a"), F.col("q__node").alias("b"), least.alias("_least"), most.alias("_most")).where(
            F.col("_least") <= limit
        )
    )
    sure = pairs.where(F.col("_most") <= limit).select("a", "b")
    open_ = pairs.where(F.col("_most") > limit).select(*keys, "a", "b")

    part = [f"_part_{c}" for c in coords]
    fine = core.withColumns({n: F.floor(F.col(c) / F.lit(side / parts)) for n, c in zip(part, coords)})
    small = _boxes(fine, [*keys, "_node", *part], coords)
    p = prefixed(small, "p_").withColumnRenamed("p__node", "a")
    q = prefixed(small, "q_").withColumnRenamed("q__node", "b")
    least, most = _box_gap(coords, "p_", "q_")
    tried = open_.join(p, [*keys, "a"]).join(q, [*keys, "b"]).withColumns({"_least": least, "_most": most}).where(F.col("_least") <= limit)
    tried = cut_lineage(tried.select(*keys, "a", "b", *["p_" + n for n in part], *["q_" + n for n in part], "_most"))
    linked = tried.where(F.col("_most") <= limit).select("a", "b").distinct()
    rest = tried.join(linked, ["a", "b"], "left_anti")
    points = fine.select(*keys, "_node", *coords, *part)
    pp = prefixed(points, "p_").withColumnRenamed("p__node", "a")
    qq = prefixed(points, "q_").withColumnRenamed("q__node", "b")
    d2 = spatial.dist2([F.col("p_" + c) for c in coords], [F.col("q_" + c) for c in coords])
    close = (
        rest.join(pp, [*keys, "a", *["p_" + n for n in part]])
        .join(qq, [*keys, "b", *["q_" + n for n in part]])
        .where(d2 <= limit)
        .select("a", "b")
        .distinct()
    )
    return sure.unionByName(linked).unionByName(close)


def euclidean_clusters(points, keys, coords, ident, eps: float, min_size: int, max_size: int) -> DataFrame:
    """Single-link clusters at ``eps`` whose size lies in the range."""
    d = density_clusters(points, keys, coords, ident, eps, 1)
    sizes = d.groupBy(*keys, "cluster").agg(F.count("*").alias("_size")).where(F.col("_size").between(min_size, max_size))
    return d.join(sizes.drop("_size"), [*keys, "cluster"], "left_semi")


def cluster_centres(clustered: DataFrame, keys: Sequence[str], fields: Sequence[str], width: float) -> DataFrame:
    """Mean (``<f>_mean``), median (``<f>_median``) and upper median of each field per cluster."""
    k = [*keys, "cluster"]
    means = clustered.groupBy(*k).agg(*[F.avg(f).alias(f"{f}_mean") for f in fields], F.count("*").alias("n_points"))
    out = means
    for tag, upper in (("median", False), ("upper_median", True)):
        m = blocks.grouped_median(clustered, k, fields, width, upper)
        out = out.join(m.select(*k, *[F.col(f).alias(f"{f}_{tag}") for f in fields]), k)
    return out
