"""Image boxes: columns x1, y1, x2, y2 and measures on pairs of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def corners(suffix: str = "") -> list[Column]:
    return [F.col(c + suffix) for c in CORNERS]


def width(b: Sequence[Column]) -> Column:
    return F.abs(b[2] - b[0])


def height(b: Sequence[Column]) -> Column:
    return F.abs(b[3] - b[1])


def area(b: Sequence[Column]) -> Column:
    return width(b) * height(b)


def centre(b: Sequence[Column]) -> list[Column]:
    return [(b[0] + b[2]) / 2, (b[1] + b[3]) / 2]


def clip(b: Sequence[Column], min_x, min_y, max_x, max_y) -> list[Column]:
    """Keep both ends of each axis inside the limits."""
    low, high = (min_x, min_y, min_x, min_y), (max_x, max_y, max_x, max_y)
    return [F.least(F.greatest(c, F.lit(float(l))), F.lit(float(h))) for c, l, h in zip(b, low, high)]


def rescale(b: Sequence[Column], factor: float) -> list[Column]:
    return [c * factor for c in b]


def resize(b: Sequence[Column], factor: float) -> list[Column]:
    """Scale about the centre."""
    (cx, cy), w, h = centre(b), width(b) * factor / 2, height(b) * factor / 2
    return [cx - w, cy - h, cx + w, cy + h]


def force_aspect(b: Sequence[Column], ratio: float) -> list[Column]:
    """Grow the shorter side about the centre until width / height = ``ratio``."""
    (cx, cy), w, h = centre(b), width(b), height(b)
    wide = w / h > ratio
    half_w, half_h = h * ratio / 2, w / ratio / 2
    return [
        F.when(wide, b[0]).otherwise(cx - half_w),
        F.when(wide, cy - half_h).otherwise(b[1]),
        F.when(wide, b[2]).otherwise(cx + half_w),
        F.when(wide, cy + half_h).otherwise(b[3]),
    ]


def upright(b: Sequence[Column]) -> list[Column]:
    """Order the corners so that x1 <= x2 and y1 <= y2."""
    return [F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])]


def intersection(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Shared area; 0 when apart."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def cover(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Share of ``a`` that ``b`` covers."""
    return F.try_divide(intersection(a, b), area(a))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    shared = intersection(a, b)
    return F.try_divide(shared, area(a) + area(b) - shared)


def centre_distance(a: Sequence[Column], b: Sequence[Column], aspect: float = -1.0) -> Column:
    """Distance of centres, each axis in half sizes of ``a`` (its width from ``aspect`` if given)."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    h = height(a)
    w = h * aspect if aspect > 0 else width(a)
    dx, dy = F.try_divide(2 * (ax - bx), w), F.try_divide(2 * (ay - by), h)
    return F.sqrt(dx * dx + dy * dy)


def match_iou(a, b, class_a: Column, class_b: Column, at_least: float = 0.5) -> Column:
    """Overlap large enough, class equal or unknown (-1) on either side."""
    return (iou(a, b) >= at_least) & ((class_a == class_b) | (class_a == -1) | (class_b == -1))


def match_cover(
    a, b, class_a: Column, class_b: Column, cover_min: float = 0.5, overlap_min: float = 0.5, dist_max: float = 0.5
) -> Column:
    """Enough cover both ways, near centres, class equal."""
    return (
        (cover(b, a) >= cover_min)
        & (cover(a, b) >= overlap_min)
        & (centre_distance(a, b) <= dist_max)
        & (class_a == class_b)
    )
