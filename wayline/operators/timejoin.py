"""Time alignment: as-of, window and bracketing joins between sensors of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators import blocks


def _asof(left, right, keys, left_time, right_time, take, width, tie, how, forward, allow_equal):
    keys, take = list(keys), list(take)
    right_first = allow_equal == (not forward)  # at equal times, which side is met first going up
    l_side, r_side = (1, 0) if right_first else (0, 1)
    lhs = left.select(
        *keys,
        F.col(left_time).alias("_t"),
        F.lit(l_side).alias("_side"),
        F.lit(None).cast("bigint").alias("_tie"),
        F.struct(*[c for c in left.columns if c not in keys]).alias("_l"),
    )
    rhs = right.select(
        *keys,
        F.col(right_time).alias("_t"),
        F.lit(r_side).alias("_side"),
        F.col(tie).cast("bigint").alias("_tie") if tie else F.lit(None).cast("bigint").alias("_tie"),
        F.struct(*take).alias("_rv"),
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    fill = blocks.fill_next if forward else blocks.fill_last
    hit = fill(both, keys, ["_t", "_side", "_tie"], {"_r": F.col("_rv")}, width).where("_l IS NOT NULL")
    if how == "inner":
        hit = hit.where("_r IS NOT NULL")
    return hit.select(*keys, "_l.*", *[F.col("_r")[c].alias(c) for c in take])


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    width: float,
    tie: str | None = None,
    how: str = "inner",
    allow_equal: bool = True,
) -> DataFrame:
    """Latest right row at or before each left row (a camera frame and its sweep).

    Both sides are shuffled once by (key, time block); no pairs are formed.
    """
    return _asof(left, right, keys, left_time, right_time, take, width, tie, how, False, allow_equal)


def asof_forward(
    left, right, keys, left_time, right_time, take, width, tie=None, how="inner", allow_equal=False
) -> DataFrame:
    """First right row after each left row (strictly after, unless ``allow_equal``)."""
    return _asof(left, right, keys, left_time, right_time, take, width, tie, how, True, allow_equal)


def window_join(
    queries: DataFrame,
    records: DataFrame,
    keys: Sequence[str],
    query_time: str,
    record_time: str,
    before: int,
    after: int,
) -> DataFrame:
    """All records with time in [t - before, t + after] of each query row.

    The range becomes an equi-join on time buckets as wide as the window, so a
    query row is copied at most twice and a hot run is spread over its buckets.
    """
    keys = list(keys)
    width = max(before + after, 1)
    q = queries.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor((F.col(query_time) - before) / F.lit(width)), F.floor((F.col(query_time) + after) / F.lit(width))
            )
        ),
    )
    r = records.withColumn("_bucket", F.floor(F.col(record_time) / F.lit(width)))
    return (
        q.join(r, [*keys, "_bucket"])
        .where(F.col(record_time).between(F.col(query_time) - before, F.col(query_time) + after))
        .drop("_bucket")
    )


def middle_of_window(
    queries: DataFrame,
    records: DataFrame,
    keys: Sequence[str],
    query_time: str,
    record_time: str,
    take: Sequence[str],
    after: int,
    width: float,
    tie: str,
) -> DataFrame:
    """Record number ``n // 2`` (from 0) of the n records with time in [t, t + after].

    The records are numbered; two as-of joins give the first and last number
    inside the window, and the middle one is fetched by an equi-join.
    """
    keys = list(keys)
    numbered = blocks.row_index(records, keys, [record_time, tie], width, "_no")
    q = queries.withColumn("_until", F.col(query_time) + F.lit(after))
    upto = numbered.select(*keys, F.col(record_time).alias("_rt"), F.col("_no").alias("_last"))
    q = asof_backward(q, upto, keys, "_until", "_rt", ["_last"], width, tie="_last")
    below = numbered.select(*keys, F.col(record_time).alias("_rt"), F.col("_no").alias("_under"))
    q = asof_backward(q, below, keys, query_time, "_rt", ["_under"], width, tie="_under", how="left", allow_equal=False)
    q = (
        q.withColumn("_under", F.coalesce("_under", F.lit(0)))
        .where("_last > _under")
        .withColumn("_no", F.col("_under") + 1 + F.floor((F.col("_last") - F.col("_under")) / 2))
    )
    return q.join(numbered.select(*keys, "_no", *take), [*keys, "_no"]).drop("_no", "_last", "_under", "_until")


def nearest_key(
    queries: DataFrame, records: DataFrame, keys: Sequence[str], query_key: str, record_key: str, reach: int = 4
) -> DataFrame:
    """Look up k, k-1, k+1, k-2, ... up to ``reach``; the first key that exists wins."""
    keys = list(keys)
    shifts = F.array(*[F.lit(s) for d in range(reach + 1) for s in ((0,) if d == 0 else (-d, d))])
    q = queries.select("*", F.posexplode(shifts).alias("_order", "_shift")).withColumn(
        "_want", F.col(query_key) + F.col("_shift")
    )
    r = records.select(*keys, F.col(record_key).alias("_want")).distinct()
    ident = queries.columns
    return (
        q.join(r, [*keys, "_want"])
        .groupBy(*ident)
        .agg(F.min_by("_want", "_order").alias("found_key"), F.min_by("_shift", "_order").alias("shift"))
    )


def bracket_poses(poses: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], width: float) -> DataFrame:
    """Each pose with the one after it: ``<col>_1`` and ``<col>_2`` for time and ``cols``."""
    every = [time, *cols]
    nxt = blocks.next_row(poses.select(*keys, *every), keys, [time], every, width)
    return nxt.where("next IS NOT NULL").select(
        *keys, *[F.col(c).alias(f"{c}_1") for c in every], *[F.col("next")[c].alias(f"{c}_2") for c in every]
    )


def interpolation_weight(time: str, t1: str, t2: str) -> Column:
    """Share of the way from pose 1 to pose 2."""
    gap = F.col(t2) - F.col(t1)
    return F.when(gap == 0, F.lit(0.0)).otherwise((F.col(time) - F.col(t1)) / gap)


def bracket_join(
    points: DataFrame, poses: DataFrame, keys: Sequence[str], point_time: str, pose_time: str, cols: Sequence[str], width: float
) -> DataFrame:
    """Poses before and after every point time, with the weight ``f`` between them.

    The as-of join runs on the distinct point times; many points share one.
    Points before the first or after the last pose have no bracket and drop out.
    """
    keys = list(keys)
    br = bracket_poses(poses, keys, pose_time, cols, width)
    take = [c for c in br.columns if c not in keys]
    times = points.select(*keys, point_time).distinct()
    hit = asof_backward(times, br, keys, point_time, f"{pose_time}_1", take, width).where(
        F.col(point_time) <= F.col(f"{pose_time}_2")
    )
    hit = hit.withColumn("f", interpolation_weight(point_time, f"{pose_time}_1", f"{pose_time}_2"))
    return points.join(hit, [*keys, point_time])


def lerp(a: str, b: str, f: str = "f") -> Column:
    """Linear mix of two columns."""
    return (1 - F.col(f)) * F.col(a) + F.col(f) * F.col(b)
