"""Cells in levels, from coarse to fine, each with the box of what it holds.

A search over all points of a key starts at a handful of coarse cells and only
goes down into those that a bound cannot rule out, so neither a distance limit
nor a pair of everything with everything is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators.spatial import cell_names, with_cell
from wayline.session import cut_lineage


def parents(coords: Sequence[str]) -> list[str]:
    return [f"_up_{c}" for c in coords]


def build(points: DataFrame, keys: Sequence[str], coords: Sequence[str], finest: float, branch: int = 4, ranges: Sequence[str] = (), sample: str | None = None) -> list[DataFrame]:
    """Levels of occupied cells, coarsest first, the last with cells of ``finest``.

    A cell has its own and its parent's number, ``_lo_c`` and ``_hi_c`` of each
    coordinate and of each of ``ranges``, and the smallest ``sample`` struct of
    its points. The coarsest level has two cells an axis at most; the number of
    levels grows with the logarithm of the extent. All levels are written.
    """
    keys, names, ups = list(keys), cell_names(coords), parents(coords)
    spans = [*coords, *ranges]
    cells = with_cell(points, coords, finest)
    base = [F.min(c).alias(f"_lo_{c}") for c in spans] + [F.max(c).alias(f"_hi_{c}") for c in spans]
    merge = [F.min(f"_lo_{c}").alias(f"_lo_{c}") for c in spans] + [F.max(f"_hi_{c}").alias(f"_hi_{c}") for c in spans]
    if sample:
        base.append(F.min(sample).alias(sample))
        merge.append(F.min(sample).alias(sample))

    def with_parents(level: DataFrame) -> DataFrame:
        return level.withColumns({u: F.floor(F.col(n) / branch) for u, n in zip(ups, names, strict=True)})

    level = cut_lineage(with_parents(cells.groupBy(*keys, *names).agg(*base)))
    largest = level.agg(F.max(F.greatest(*[F.abs(n) for n in names]))).first()[0] if len(names) > 1 else level.agg(F.max(F.abs(names[0]))).first()[0]
    levels = [level]
    while (largest or 0) > 1:
        largest = -(-largest // branch)
        up = level.select(*keys, *[F.col(u).alias(n) for u, n in zip(ups, names, strict=True)], *[c for c in level.columns if c not in (*keys, *names, *ups)])
        level = cut_lineage(with_parents(up.groupBy(*keys, *names).agg(*merge)))
        levels.append(level)
    return levels[::-1]


def middle(c: str) -> Column:
    return (F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2


def half_diagonal(coords: Sequence[str]) -> Column:
    """Radius of the ball around a cell's box."""
    total = None
    for c in coords:
        d = (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / 2
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def descend(asked: DataFrame, levels: Sequence[DataFrame], keys: Sequence[str], coords: Sequence[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``asked`` with the numbers of the finest cells that are left, a row per pair.

    ``keep`` gets pairs of ``asked`` rows and cells and returns those to go on
    with; it may change the columns of ``asked``, which it must all keep.
    """
    keys, names, ups = list(keys), cell_names(coords), parents(coords)
    cols = asked.columns
    open_ = keep(asked.join(levels[0].drop(*ups), keys)).select(*cols, *names)
    for level in levels[1:]:
        above = open_.withColumnsRenamed(dict(zip(names, ups, strict=True)))
        open_ = keep(above.join(level, [*keys, *ups]).drop(*ups)).select(*cols, *names)
    return open_
