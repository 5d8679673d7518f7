"""Ordered work on hot groups: windows in two levels.

A plain window over one run puts the whole run into one task. Here the order
column is cut into blocks of ``width``; each (key, block) is a window of its
own, and only one summary row per block is combined over the whole key. Rows
per task are bounded by the recording rate times ``width``, whatever share of
the table one key holds. The block summary is a partial aggregate, so the rows
themselves are shuffled once, by (key, block).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.session import cut_lineage

BLOCK = "_blk"


def with_block(df: DataFrame, order: str, width: float) -> DataFrame:
    """Add the block number of the order column (monotone in it)."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(width)))


def _windows(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(BLOCK), W.partitionBy(*keys, BLOCK).orderBy(*order)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    width: float,
    inclusive: bool = True,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Cumulative sums in order; ``inclusive=False`` leaves out the row itself.

    ``totals`` names further columns for the whole key's sum of a value.
    """
    keys, order = list(keys), list(order)
    over_blocks, in_block = _windows(keys, order)
    before = over_blocks.rowsBetween(W.unboundedPreceding, -1)
    upto = in_block.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    d = with_block(df, order[0], width).withColumns({f"_v_{n}": c for n, c in values.items()})
    offsets = (
        d.groupBy(*keys, BLOCK)
        .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
        .select(
            *keys,
            BLOCK,
            *[F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in values],
            *[F.sum(f"_s_{n}").over(W.partitionBy(*keys)).alias(t) for n, t in (totals or {}).items()],
        )
    )
    zero = F.lit(0)
    out = d.join(offsets, [*keys, BLOCK]).withColumns(
        {n: F.coalesce(F.sum(f"_v_{n}").over(upto), zero) + F.coalesce(F.col(f"_o_{n}"), zero) for n in values}
    )
    return out.drop(BLOCK, *[p + n for n in values for p in ("_v_", "_o_")])


def global_running_sum(df: DataFrame, order: Column, values: Mapping[str, Column]) -> DataFrame:
    """Cumulative sums over all rows in ``order``, where no key shares out the work.

    Rows are sorted into ranges of the order, written, and summed inside them;
    only one row a range is combined over all, and its sums are added to the next
    ranges. Rows of one place in the order stay in one range; give each a place
    of its own (or merge equal ones first) to bound the ranges.
    """
    d = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    d = cut_lineage(d.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = d.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    offsets = offsets.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    upto = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = d.join(F.broadcast(offsets), "_range").withColumns({n: F.sum(f"_v_{n}").over(upto) + F.col(f"_o_{n}") for n in values})
    return out.drop("_range", *[p + n for n in values for p in ("_v_", "_o_")])


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, name: str = "rn") -> DataFrame:
    """Row number from 1 in each key."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, width)


def fill_around(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: float,
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Nearest non-null values before (``last``) and after (``following``) each row, in one pass over the blocks."""
    keys, order = list(keys), list(order)
    last, following = dict(last or {}), dict(following or {})
    values = {**last, **following}
    over_blocks, in_block = _windows(keys, order)
    near = 0 if include_current else 1
    rank = F.struct(*order)
    # per direction: picker, edge row of a block, frame inside the block, frame over the other blocks
    back = (F.last, F.max_by, in_block.rowsBetween(W.unboundedPreceding, -near), over_blocks.rowsBetween(W.unboundedPreceding, -1))
    ahead = (F.first, F.min_by, in_block.rowsBetween(near, W.unboundedFollowing), over_blocks.rowsBetween(1, W.unboundedFollowing))
    way = {n: back if n in last else ahead for n in values}
    d = with_block(df, order[0], width).withColumns({f"_v_{n}": c for n, c in values.items()})
    carried = (
        d.groupBy(*keys, BLOCK)
        .agg(*[way[n][1](F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_e_{n}") for n in values])
        .select(*keys, BLOCK, *[way[n][0](f"_e_{n}", ignorenulls=True).over(way[n][3]).alias(f"_o_{n}") for n in values])
    )
    out = d.join(carried, [*keys, BLOCK]).withColumns(
        {n: F.coalesce(way[n][0](f"_v_{n}", ignorenulls=True).over(way[n][2]), F.col(f"_o_{n}")) for n in values}
    )
    return out.drop(BLOCK, *[p + n for n in values for p in ("_v_", "_o_")])


def fill_last(df, keys, order, values: Mapping[str, Column], width: float, include_current: bool = True) -> DataFrame:
    """Last non-null value at or before the row (before it when ``include_current`` is off)."""
    return fill_around(df, keys, order, width, last=values, include_current=include_current)


def fill_next(df, keys, order, values: Mapping[str, Column], width: float, include_current: bool = True) -> DataFrame:
    """First non-null value at or after the row."""
    return fill_around(df, keys, order, width, following=values, include_current=include_current)


def previous_row(df, keys, order, cols: Sequence[str], width: float, name: str = "prev") -> DataFrame:
    """Struct ``name`` with ``cols`` of the row before; null on the first row."""
    return fill_last(df, keys, order, {name: F.struct(*cols)}, width, include_current=False)


def next_row(df, keys, order, cols: Sequence[str], width: float, name: str = "next") -> DataFrame:
    """Struct ``name`` with ``cols`` of the row after; null on the last row."""
    return fill_next(df, keys, order, {name: F.struct(*cols)}, width, include_current=False)


def grouped_median(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], width: float, upper: bool = False
) -> DataFrame:
    """Exact median per key of several columns, without holding a key's values in one task.

    Equal values are counted first; running counts in value blocks then find the
    middle one (or two). ``upper`` takes the upper of the two middle values.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_x")) for v in values])).alias("_s"),
    ).select(*keys, "_s._name", "_s._x").where(F.col("_x").isNotNull())
    # written once: the running counts read it twice, and what led here is often a join
    counts = cut_lineage(long.groupBy(*keys, "_name", "_x").agg(F.count("*").alias("_n")))
    k = [*keys, "_name"]
    cum = running_sum(counts, k, ["_x"], {"_cum": F.col("_n")}, width, totals={"_cum": "_total"})
    lo, hi = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    start = F.col("_cum") - F.col("_n")

    def holds(pos):
        return (start < pos) & (F.col("_cum") >= pos)

    mid = (
        cum.where(holds(hi) if upper else holds(lo) | holds(hi))
        .groupBy(*k)
        .agg(((F.min("_x") + F.max("_x")) / 2).alias("_m"))
    )
    return mid.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == v, F.col("_m"))).alias(v) for v in values])


def halo_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, block_rows: int, halo: int
) -> DataFrame:
    """Cut each key into blocks of ``block_rows`` consecutive rows, with ``halo`` rows of both neighbours added.

    Adds ``block``, ``pos`` (row position in the key from 0) and ``own``. For
    recursions whose memory fades, a solver run on a block and its halo gives
    the rows of the block to double precision, and no task holds a whole key.
    """
    if halo > block_rows:
        raise ValueError("the halo must fit into one block")
    d = row_index(df, keys, order, width, "_rn").withColumn("pos", F.col("_rn") - 1).drop("_rn")
    home = F.floor(F.col("pos") / block_rows)
    near = F.array_distinct(
        F.array(home, F.floor((F.col("pos") + halo) / block_rows), F.floor(F.greatest(F.col("pos") - halo, F.lit(0)) / block_rows))
    )
    return d.withColumn("_home", home).withColumn("block", F.explode(near)).withColumn("own", F.col("block") == F.col("_home")).drop("_home")
