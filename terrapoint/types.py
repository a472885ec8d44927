"""Boxes, configuration and errors. Points are the scalar columns x0 .. x{D-1} beside an `id`."""

from __future__ import annotations

import math
from dataclasses import dataclass


class SpatialError(ValueError):
    """Base of the library's errors."""


class ConfigError(SpatialError):
    pass


class DimensionError(SpatialError):
    pass


class SnapshotError(SpatialError):
    pass


#: Layout names, with the short forms that are also accepted. Fixed values.
LAYOUT_NAMES = {"rtree": "rtree", "rt": "rtree", "kdtree": "kdtree", "kd": "kdtree", "quadtree": "quadtree", "quad": "quadtree", "grid": "grid"}


def layout_name(text: str) -> str:
    try:
        return LAYOUT_NAMES[text.strip().lower()]
    except KeyError:
        raise ConfigError(f"no layout is called {text!r}") from None


def axes(dims: int) -> list[str]:
    """Names of the coordinate columns; 1 to 8 axes."""
    if not 1 <= dims <= 8:
        raise DimensionError(f"{dims} axes; 1 to 8 are supported")
    return [f"x{d}" for d in range(dims)]


@dataclass(frozen=True)
class BBox:
    """Closed box. An inverted box (lo > hi on some axis) holds nothing."""

    lo: tuple[float, ...]
    hi: tuple[float, ...]

    def __post_init__(self):
        object.__setattr__(self, "lo", tuple(float(v) for v in self.lo))
        object.__setattr__(self, "hi", tuple(float(v) for v in self.hi))
        if len(self.lo) != len(self.hi):
            raise DimensionError("corners of different length")
        axes(len(self.lo))
        if any(math.isnan(v) for v in self.lo + self.hi):
            raise ConfigError("a box with NaN")

    @property
    def dims(self) -> int:
        return len(self.lo)

    @classmethod
    def around(cls, point) -> BBox:
        """The degenerate box of one point."""
        return cls(tuple(point), tuple(point))

    def merge(self, other: BBox) -> BBox:
        return BBox(tuple(map(min, self.lo, other.lo)), tuple(map(max, self.hi, other.hi)))

    def area(self) -> float:
        return math.prod(max(b - a, 0.0) for a, b in zip(self.lo, self.hi, strict=True))

    def enlargement(self, other: BBox) -> float:
        return self.merge(other).area() - self.area()

    def intersects(self, other: BBox) -> bool:
        return all(b >= c and d >= a for a, b, c, d in zip(self.lo, self.hi, other.lo, other.hi, strict=True))

    def contains(self, point) -> bool:
        return all(a <= v <= b for a, v, b in zip(self.lo, point, self.hi, strict=True))


@dataclass(frozen=True)
class SpatialConfig:
    """Settings of an index, kept in its manifest."""

    initial_layout: str = "kdtree"
    migration_threshold: float = 0.77
    hysteresis_window: int = 1000
    reservoir_size: int = 4096
    bloom_bytes: int = 65_536
    bloom_hashes: int = 7
    max_migration_latency_us: int = 50
    leaf_rows: int = 100_000
    most_deltas: int = 64

    def __post_init__(self):
        object.__setattr__(self, "initial_layout", layout_name(self.initial_layout))
        if not 0 < self.migration_threshold <= 1 or self.hysteresis_window < 0 or self.reservoir_size < 1 or self.bloom_bytes < 8 or self.bloom_hashes < 1 or self.leaf_rows < 1 or self.most_deltas < 1:
            raise ConfigError("a setting is out of range")
