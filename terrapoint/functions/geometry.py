"""Geometry as Column expressions over x0.., or over lo0../hi0.. for boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapoint.types import BBox, DimensionError, axes


def contains(box: BBox) -> Column:
    """Whether the row's point lies in the closed box; plain comparisons, so that they reach the Parquet scan."""
    return reduce(Column.__and__, [(F.col(a) >= lo) & (F.col(a) <= hi) for a, lo, hi in zip(axes(box.dims), box.lo, box.hi, strict=True)])


def contains_columns(dims: int, prefix: str = "") -> Column:
    """Whether the point x0.. lies in the box of the columns {prefix}lo0.. and {prefix}hi0..."""
    return reduce(Column.__and__, [(F.col(a) >= F.col(f"{prefix}lo{d}")) & (F.col(a) <= F.col(f"{prefix}hi{d}")) for d, a in enumerate(axes(dims))])


def intersects(dims: int, a: str, b: str) -> Column:
    """Whether the boxes with the column prefixes a and b meet; touching counts."""
    return reduce(Column.__and__, [(F.col(f"{a}hi{d}") >= F.col(f"{b}lo{d}")) & (F.col(f"{b}hi{d}") >= F.col(f"{a}lo{d}")) for d in range(dims)])


def merged(dims: int, a: str, b: str) -> list[Column]:
    """lo0.., hi0.. of the union box."""
    return [F.least(F.col(f"{a}lo{d}"), F.col(f"{b}lo{d}")).alias(f"lo{d}") for d in range(dims)] + [F.greatest(F.col(f"{a}hi{d}"), F.col(f"{b}hi{d}")).alias(f"hi{d}") for d in range(dims)]


def area(lo: list[Column], hi: list[Column]) -> Column:
    return reduce(Column.__mul__, [F.greatest(h - l, F.lit(0.0)) for l, h in zip(lo, hi, strict=True)])


def box_area(dims: int, prefix: str = "") -> Column:
    return area([F.col(f"{prefix}lo{d}") for d in range(dims)], [F.col(f"{prefix}hi{d}") for d in range(dims)])


def enlargement(dims: int, a: str, b: str) -> Column:
    """Area of the union less the area of the first box."""
    lo = [F.least(F.col(f"{a}lo{d}"), F.col(f"{b}lo{d}")) for d in range(dims)]
    hi = [F.greatest(F.col(f"{a}hi{d}"), F.col(f"{b}hi{d}")) for d in range(dims)]
    return area(lo, hi) - box_area(dims, a)


def distance(point, prefix: str = "") -> Column:
    """Euclidean distance of x0.. to a point: numbers, or the columns {prefix}0.. when `point` is a number of axes."""
    if isinstance(point, int):
        other = [F.col(f"{prefix}{d}") for d in range(point)]
    else:
        other = [F.lit(float(v)) for v in point]
    if not other:
        raise DimensionError("a point without coordinates")
    squares = [(F.col(a) - o) * (F.col(a) - o) for a, o in zip(axes(len(other)), other, strict=True)]
    return F.sqrt(reduce(Column.__add__, squares))


def finite(dims: int) -> Column:
    """Whether all coordinates are given and finite."""
    return reduce(Column.__and__, [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < F.lit(float("inf"))) for a in axes(dims)])
