"""Voxel maps: downsampling, occupancy from rays, colours, static and hidden points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators.blocks import BLOCK

VOXEL = ["vx", "vy", "vz"]
AXES = ["x", "y", "z"]


def with_voxel(df: DataFrame, size: float, coords: Sequence[str] = AXES) -> DataFrame:
    return df.withColumns({v: F.floor(F.col(c) / F.lit(float(size))) for v, c in zip(VOXEL, coords)})


def downsample(points: DataFrame, size: float, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of all fields per voxel, with the number of points."""
    return with_voxel(points, size).groupBy(*keys, *VOXEL).agg(*[F.avg(f).alias(f) for f in fields], F.count("*").alias("n_points"))


def explode_rays(df: DataFrame, origin: Sequence[Column], keep: Sequence[str], size: float) -> DataFrame:
    """Voxels each ray from ``origin`` to x, y, z passes through, without the one it ends in: ``keep`` and vx, vy, vz.

    The ray is cut where it crosses a voxel face; the middle of each piece
    names the voxel. Every step is a column of its own, so nothing is computed twice.
    """
    names = [f"_o{a}" for a in AXES]
    d = df.select(*dict.fromkeys([*keep, *AXES]), *[o.alias(n) for o, n in zip(origin, names)])
    for a, n in zip(AXES, names):
        lo, hi = F.floor(F.col(n) / F.lit(float(size))), F.floor(F.col(a) / F.lit(float(size)))
        d = d.withColumns({f"_a{a}": F.least(lo, hi) + 1, f"_b{a}": F.greatest(lo, hi), f"_e{a}": hi, f"_d{a}": F.col(a) - F.col(n)})

    def crossings(a: str, n: str) -> Column:
        low, high = F.col(f"_a{a}"), F.col(f"_b{a}")
        faces = F.when(low <= high, F.sequence(low, F.greatest(high, low))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(faces, lambda k: (k * F.lit(float(size)) - F.col(n)) / F.col(f"_d{a}"))

    cuts = F.concat(F.array(F.lit(0.0), F.lit(1.0)), *[crossings(a, n) for a, n in zip(AXES, names)])
    d = d.withColumn("_ts", F.sort_array(cuts)).drop(*[f"_{p}{a}" for a in AXES for p in "ab"])
    n = F.size("_ts") - 1
    pairs = F.arrays_zip(F.slice("_ts", 1, n).alias("a"), F.slice("_ts", 2, n).alias("b"))
    d = d.withColumn("_p", F.explode(pairs)).where(F.col("_p.b") - F.col("_p.a") > 1e-12)
    middle = (F.col("_p.a") + F.col("_p.b")) / 2
    d = d.withColumns({v: F.floor((F.col(o) + middle * F.col(f"_d{a}")) / F.lit(float(size))) for v, o, a in zip(VOXEL, names, AXES)})
    own = (F.col("vx") == F.col("_ex")) & (F.col("vy") == F.col("_ey")) & (F.col("vz") == F.col("_ez"))
    return d.where(~own).select(*keep, *VOXEL)


def _clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(value, high), low)


def scan_voxels(points: DataFrame, scan: str, origin: Sequence[Column], size: float, ray_scan: str | None = None) -> DataFrame:
    """One row per scan and voxel: ``hit`` where a return lies in it, else crossed by a ray only.

    The voxels a ray crosses count for the scan in ``ray_scan``, if that is not
    the scan of its return.
    """
    ends = with_voxel(points, size).select(scan, *VOXEL, F.lit(1).alias("_hit"))
    crossed = explode_rays(points, origin, [ray_scan or scan], size).withColumnRenamed(ray_scan or scan, scan).withColumn("_hit", F.lit(0))
    return ends.unionByName(crossed).groupBy(scan, *VOXEL).agg((F.max("_hit") == 1).alias("hit"))


def occupancy(
    points: DataFrame,
    scan: str,
    origin: Sequence[Column],
    size: float,
    p_hit: float = 0.7,
    p_miss: float = 0.4,
    p_min: float = 0.12,
    p_max: float = 0.97,
    scans_per_block: int = 1024,
    ray_scan: str | None = None,
) -> DataFrame:
    """Clamped log-odds per voxel, scans taken in order.

    Adding and clamping is a map x -> clamp(x + a, lo, hi), and such maps
    compose to one of the same form. So each block of scans is folded by itself
    to (a, lo, hi), at most ``scans_per_block`` entries at a time, and the
    blocks are folded after; a voxel seen by every scan is never gathered whole.
    """
    odds = {n: math.log(p / (1 - p)) for n, p in (("hit", p_hit), ("miss", p_miss), ("min", p_min), ("max", p_max))}
    low, high = F.lit(odds["min"]), F.lit(odds["max"])
    step = F.when(F.col("hit"), F.lit(odds["hit"])).otherwise(F.lit(odds["miss"]))
    d = scan_voxels(points, scan, origin, size, ray_scan).select(
        *VOXEL, F.col(scan).alias("_scan"), step.alias("_a"), F.floor(F.col(scan) / scans_per_block).alias(BLOCK)
    )

    def compose(first, a, lo, hi):
        """The map (a, lo, hi) after ``first``."""
        return F.struct(
            (first["a"] + a).alias("a"), _clamp(first["lo"] + a, lo, hi).alias("lo"), _clamp(first["hi"] + a, lo, hi).alias("hi")
        )

    def fold(entries: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("a"), F.lit(-1e300).alias("lo"), F.lit(1e300).alias("hi"))
        return F.aggregate(entries, start, lambda acc, e: compose(acc, e["a"], e["lo"], e["hi"]))

    one = F.struct(F.col("_scan").alias("at"), F.col("_a").alias("a"), low.alias("lo"), high.alias("hi"))
    per_block = d.groupBy(*VOXEL, BLOCK).agg(fold(F.array_sort(F.collect_list(one))).alias("_m"), F.count("*").alias("_n"))
    block = F.struct(F.col(BLOCK).alias("at"), F.col("_m.a").alias("a"), F.col("_m.lo").alias("lo"), F.col("_m.hi").alias("hi"))
    whole = per_block.groupBy(*VOXEL).agg(fold(F.array_sort(F.collect_list(block))).alias("_m"), F.sum("_n").alias("n_scans"))
    return whole.select(*VOXEL, "n_scans", _clamp(F.col("_m.a"), F.col("_m.lo"), F.col("_m.hi")).alias("log_odds"))


def single_scan_occupancy(points: DataFrame, scan: str, origin: Sequence[Column], size: float) -> DataFrame:
    """Without clamping and with certain hits: any hit makes the voxel occupied."""
    return scan_voxels(points, scan, origin, size).groupBy(*VOXEL).agg(F.max("hit").alias("occupied"))


def probability(log_odds: Column) -> Column:
    return 1 - 1 / (1 + F.exp(log_odds))


def last_colour(points: DataFrame, size: float, order: Sequence[str], colours: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Colour written last in each voxel."""
    d = with_voxel(points, size).groupBy(*VOXEL).agg(F.max_by(F.struct(*colours), F.struct(*order)).alias("_c"))
    return d.select(*VOXEL, *[F.col("_c")[c].alias(c) for c in colours])


def colour_voxels(occupied: DataFrame, colours: DataFrame) -> DataFrame:
    """Occupancy voxels with their colour; null where none was written."""
    return occupied.join(colours, VOXEL, "left")


def export_voxels(voxels: DataFrame, size: float) -> DataFrame:
    """Centre, size and occupancy probability."""
    centres = [((F.col(v) + 0.5) * F.lit(float(size))).alias(a) for v, a in zip(VOXEL, AXES)]
    rest = [c for c in voxels.columns if c not in (*VOXEL, "log_odds", "n_scans")]
    return voxels.select(*centres, F.lit(float(size)).alias("size"), probability(F.col("log_odds")).alias("occupancy"), *rest)


def split_static(points: DataFrame, voxels: DataFrame, size: float, static: bool = True) -> DataFrame:
    """Points whose voxel is known and occupied (``static``), or all others."""
    occupied = voxels.where("log_odds > 0").select(*VOXEL)
    return with_voxel(points, size).join(occupied, VOXEL, "left_semi" if static else "left_anti").drop(*VOXEL)


def mark_static(points: DataFrame, voxels: DataFrame, size: float) -> DataFrame:
    """All points with boolean ``static``: their voxel is known and occupied."""
    occupied = voxels.where("log_odds > 0").select(*VOXEL, F.lit(True).alias("static"))
    return with_voxel(points, size).join(occupied, VOXEL, "left").withColumn("static", F.coalesce("static", F.lit(False))).drop(*VOXEL)


def hide_occluded(samples: DataFrame, voxels: DataFrame, origin: Sequence[Column], size: float, ident: Sequence[str], gap: float = 3.0) -> DataFrame:
    """Drop samples whose ray from the camera meets an occupied voxel more than ``gap`` before the point."""
    occupied = voxels.where("log_odds > 0").select(*VOXEL)
    path = explode_rays(samples, origin, [*ident, *AXES], size)
    away = [(F.col(v) + 0.5) * F.lit(float(size)) - F.col(a) for v, a in zip(VOXEL, AXES)]
    far = F.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2]) > gap
    hidden = path.where(far).join(occupied, VOXEL, "left_semi").select(*ident).distinct()
    return samples.join(hidden, list(ident), "left_anti")


def upsample_rings(points: DataFrame, keys: Sequence[str], laser: str, coords: Sequence[str], ident: str, n: int, reach: float = 0.5) -> DataFrame:
    """Points between ring k and ring k + 2: ``n`` evenly spaced ones per pair nearer than ``reach``, plus the originals.

    New points carry the source's id, their number ``step`` (0 for originals) and a null laser.
    """
    from wayline.operators.spatial import nearest_within

    keys = list(keys)
    source = points.withColumn("_ring", F.col(laser) + 2)
    target = points.select(*keys, F.col(laser).alias("_ring"), F.col(ident).alias("_tid"), *coords)
    pairs = nearest_within(source, target, [*keys, "_ring"], coords, reach, "_tid", place="_e_")
    pairs = pairs.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    share = F.col("step") / F.lit(float(n + 1))
    new = pairs.select(
        *keys, ident, "step", F.lit(None).cast("int").alias(laser),
        *[((1 - share) * F.col(c) + share * F.col(f"_e_{c}")).alias(c) for c in coords],
    )
    return points.select(*keys, ident, F.lit(0).alias("step"), F.col(laser).cast("int").alias(laser), *coords).unionByName(new)
