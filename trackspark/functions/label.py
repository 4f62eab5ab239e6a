"""Threshold and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_band(x, low, high) -> Column:
    """1 where low < x < high, else 0 (nulls are 0)."""
    x = col(x)
    return F.when((x > low) & (x < high), 1).otherwise(0).cast("long")


def above(x, threshold) -> Column:
    return F.when(col(x) > threshold, 1).otherwise(0).cast("long")


def clip(x, low, high) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def cut(x, bounds: list[float], names: list[str]) -> Column:
    """names[i] for the first bound b with x < b (closed above), the last name beyond all of them."""
    out = F.when(col(x) < bounds[0], names[0])
    for b, n in zip(bounds[1:], names[1:]):
        out = out.when(col(x) < b, n)
    return out.when(col(x).isNotNull(), names[-1])


def cut_above(x, bounds: list[float], names: list[str]) -> Column:
    """As ``cut`` with x <= b (open above)."""
    out = F.when(col(x) <= bounds[0], names[0])
    for b, n in zip(bounds[1:], names[1:]):
        out = out.when(col(x) <= b, n)
    return out.when(col(x).isNotNull(), names[-1])


def merge_classes(first, second) -> Column:
    """2 where ``second`` is set, else 1 where ``first`` is, else 0."""
    return F.when(col(second) == 1, 2).when(col(first) == 1, 1).otherwise(0).cast("long")


def crop_bounds(pos, extent: int, width: int = 200) -> tuple[Column, Column]:
    """[low, high) of a window of ``width`` around ``pos`` shifted to lie inside [0, extent)."""
    p, half = col(pos), width // 2
    low = F.when(p + half >= extent, extent - width).when(p - half < 0, 0).otherwise(p - half)
    return low.cast("long"), (low + width).cast("long")


def frequency_weight(f, form: str) -> Column:
    """Weight of a frequency: 'linear' f in (2,10), 'square' f^2 in (1.5,5), 'capped' 0 / f / 5 / 0 at 2, 5, 10."""
    f = col(f)
    if form == "linear":
        return F.when((f > 2) & (f < 10), f).otherwise(0.0)
    if form == "square":
        return F.when((f > 1.5) & (f < 5), f * f).otherwise(0.0)
    return F.when((f <= 2) | (f > 10), 0.0).when(f > 5, 5.0).otherwise(f)
