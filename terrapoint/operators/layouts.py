"""Physical layouts: where rows live. All give the same answers; they differ in how many leaves a box can skip.

A layout is fitted on a bounded sample and assigns each row a leaf number with built-in expressions. The leaf table
(bounding box and rows of each leaf, `MOST_LEAVES` at most) turns a box into the leaves to read."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapoint.functions import geometry, keys
from terrapoint.operators.aggregate import extent_box, sampled_points
from terrapoint.types import BBox, ConfigError, axes, layout_name

MOST_LEAVES = 4096
#: 64 rows a leaf, so that chance moves its size by an eighth (a quarter at 16 rows).
SAMPLE_ROWS = 64 * MOST_LEAVES


class Layout(ABC):
    """Extension point: a new layout defines fit() and leaf()."""

    name = ""

    @classmethod
    @abstractmethod
    def fit(cls, df: DataFrame, dims: int, leaf_rows: int) -> Layout: ...

    @abstractmethod
    def leaf(self) -> Column:
        """Leaf number (long) of a row."""

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn("leaf", self.leaf())


def _cells(dims: int, box: BBox | None) -> tuple[list[Column], int]:
    order = keys.layout_order(dims)
    lo, hi = (box.lo, box.hi) if box is not None else ([0.0] * dims, [1.0] * dims)
    return [keys.normalised(F.col(a), l, h, order) for a, l, h in zip(axes(dims), lo, hi, strict=True)], order


def curve_key(dims: int, box: BBox | None) -> Column:
    """Place of a row along the space-filling curve over the box."""
    return keys.curve_key(*_cells(dims, box))


def curve_sorted(df: DataFrame, dims: int, box: BBox | None) -> DataFrame:
    """df in ranges along the space-filling curve over the box, each sorted, so that near points share files and row
    groups. Equal places go by id."""
    keyed = df.withColumn("curve_", curve_key(dims, box))
    return keyed.repartitionByRange("curve_", "id").sortWithinPartitions("curve_", "id").drop("curve_")


def clustered(assigned: DataFrame, dims: int, box: BBox | None) -> DataFrame:
    """Rows with a leaf, in ranges of leaves and inside a leaf by interleaved key, so that the row groups of a large
    leaf cover small parts of it on every axis."""
    keyed = assigned.withColumn("z_", keys.z_key(*_cells(dims, box)))
    return keyed.repartitionByRange("leaf", "z_").sortWithinPartitions("leaf", "z_").drop("z_")


def leaf_table(assigned: DataFrame, dims: int) -> DataFrame:
    """leaf, n, lo0.., hi0.. of each leaf."""
    return assigned.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{s}{d}") for d, a in enumerate(axes(dims)) for s, f in (("lo", F.min), ("hi", F.max))])


def leaves_for(table: DataFrame, box: BBox) -> list[int]:
    """Leaves whose bounding box meets the box."""
    meets = [(F.col(f"lo{d}") <= box.hi[d]) & (F.col(f"hi{d}") >= box.lo[d]) for d in range(box.dims)]
    for m in meets:
        table = table.where(m)
    return sorted(r["leaf"] for r in table.select("leaf").collect())  # MOST_LEAVES at most


def pruned_range(assigned: DataFrame, table: DataFrame, box: BBox) -> DataFrame:
    """The range query over the leaves that can hold answers; on a table partitioned by leaf, no other is read."""
    return assigned.where(F.col("leaf").isin(leaves_for(table, box))).where(geometry.contains(box))


def _wanted(n: int, leaf_rows: int) -> int:
    return max(1, min(MOST_LEAVES, -(-n // leaf_rows)))


def _sample(df: DataFrame, dims: int) -> np.ndarray:
    return sampled_points(df, dims, SAMPLE_ROWS)


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class GridLayout(Layout):
    """Equal cells over the extent."""

    name = "grid"

    def __init__(self, cells: int, sizes: list[float], origins: list[float]):
        self.cells, self.sizes, self.origins = cells, sizes, origins

    @classmethod
    def fit(cls, df, dims, leaf_rows):
        n, box = extent_box(df, dims)
        cells = max(1, int(_wanted(n, leaf_rows) ** (1 / dims) + 1e-9))
        if box is None:
            return cls(1, [0.0] * dims, [0.0] * dims)
        return cls(cells, [(b - a) / cells for a, b in zip(box.lo, box.hi, strict=True)], list(box.lo))

    def leaf(self):
        out = F.lit(0).cast("long")
        for a, s, o in zip(axes(len(self.sizes)), self.sizes, self.origins, strict=True):
            cell = F.greatest(F.lit(0).cast("long"), F.least(keys.grid_cell(F.col(a), s, o), F.lit(self.cells - 1).cast("long")))
            out = out * self.cells + cell
        return out


class QuadLayout(Layout):
    """Whole quadrants: the top bits of the interleaved key."""

    name = "quadtree"

    def __init__(self, depth: int, lo: list[float], hi: list[float]):
        self.depth, self.lo, self.hi = depth, lo, hi

    @classmethod
    def fit(cls, df, dims, leaf_rows):
        n, box = extent_box(df, dims)
        depth = int(math.log2(_wanted(n, leaf_rows)) / dims + 1e-9)
        return cls(depth, *([[0.0] * dims, [1.0] * dims] if box is None else [list(box.lo), list(box.hi)]))

    def leaf(self):
        if not self.depth:
            return F.lit(0).cast("long")
        cells = [keys.normalised(F.col(a), lo, hi, self.depth) for a, lo, hi in zip(axes(len(self.lo)), self.lo, self.hi, strict=True)]
        return keys.z_key(cells, self.depth)


def _even_cut(values: np.ndarray) -> tuple[int, float]:
    """(rows on the smaller side, cut): between two different values, as near to the middle as equal ones allow; no
    rows where all are equal."""
    v = np.sort(values)
    ends = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows up to each cut
    if not len(ends):
        return 0, float(v[0])
    at = int(ends[np.argmin(np.abs(2 * ends - len(v)))])
    low, high = float(v[at - 1]), float(v[at])
    middle = low / 2 + high / 2
    return min(at, len(v) - at), middle if low <= middle < high else low


class KDLayout(Layout):
    """Median splits, from the sample, on the widest axis of those where equal values leave both sides three eighths of
    the rows, or else on the axis that divides them most evenly; a leaf is found by one walk over literal arrays."""

    name = "kdtree"

    def __init__(self, depth: int, axis: list[int], cut: list[float], dims: int):
        self.depth, self.axis, self.cut, self.dims = depth, axis, cut, dims

    @classmethod
    def fit(cls, df, dims, leaf_rows):
        points = _sample(df, dims)
        depth = int(math.log2(_wanted(df.count(), leaf_rows)))
        axis, cut, groups = [], [], [points]
        for _ in range(depth):
            following = []
            for g in groups:
                d, m = cls._split(g) if len(g) else (0, 0.0)
                axis.append(d)
                cut.append(m)
                following += [g[g[:, d] <= m], g[g[:, d] > m]] if len(g) else [g, g]
            groups = following
        return cls(depth, axis, cut, dims)

    @staticmethod
    def _split(g: np.ndarray) -> tuple[int, float]:
        cuts = [_even_cut(g[:, d]) for d in range(g.shape[1])]
        fair = max(1, min(3 * len(g) // 8, max(least for least, _ in cuts)))
        width = g.max(axis=0) - g.min(axis=0)
        d = max(range(len(cuts)), key=lambda d: (cuts[d][0] >= fair, width[d]))
        return d, cuts[d][1]

    def leaf(self):
        if not self.depth:
            return F.lit(0).cast("long")
        axis, cut = F.array(*[F.lit(a) for a in self.axis]), _doubles(self.cut)
        x = F.array(*[F.col(a) for a in axes(self.dims)])
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), lambda node, _: F.when(F.get(x, F.get(axis, node)) > F.get(cut, node), 2 * node + 2).otherwise(2 * node + 1).cast("int"))
        return (walk - ((1 << self.depth) - 1)).cast("long")


class STRLayout(Layout):
    """Sort-tile-recursive packing: slabs of equal counts on the first axis, within each on the second, and so on."""

    name = "rtree"

    def __init__(self, tiles: int, bounds: list[list[list[float]]]):
        self.tiles, self.bounds = tiles, bounds

    @classmethod
    def fit(cls, df, dims, leaf_rows):
        points = _sample(df, dims)
        tiles = max(1, int(_wanted(df.count(), leaf_rows) ** (1 / dims) + 1e-9))
        bounds, groups = [], [points]
        for d in range(dims):
            level, following = [], []
            for g in groups:
                cuts = np.quantile(g[:, d], np.arange(1, tiles) / tiles).tolist() if len(g) and tiles > 1 else [0.0] * (tiles - 1)
                level.append(cuts)
                at = np.searchsorted(cuts, g[:, d], side="right") if len(g) else np.empty(0, dtype=int)
                following += [g[at == t] for t in range(tiles)]
            bounds.append(level)
            groups = following
        return cls(tiles, bounds)

    def leaf(self):
        out = F.lit(0)
        for a, level in zip(axes(len(self.bounds)), self.bounds, strict=True):
            if self.tiles > 1:
                cuts = F.get(F.array(*[_doubles(c) for c in level]), out)
                out = _tiled(out, cuts, a, self.tiles)
        return out.cast("long")


def _tiled(out: Column, cuts: Column, axis: str, tiles: int) -> Column:
    x = F.col(axis)
    return (out * tiles + F.size(F.filter(cuts, lambda c: c <= x))).cast("int")


LAYOUTS: dict[str, type[Layout]] = {c.name: c for c in (STRLayout, KDLayout, QuadLayout, GridLayout)}


def fit(name: str, df: DataFrame, dims: int, leaf_rows: int) -> Layout:
    kind = layout_name(name)
    if kind == "quadtree" and dims > 4:
        raise ConfigError("the quadtree layout is for 4 axes at most")
    return LAYOUTS[kind].fit(df, dims, leaf_rows)


def statistics(table: DataFrame) -> DataFrame:
    """One row: leaves, rows of the fullest leaf, and the depth of a balanced binary tree over the leaves."""
    n = F.count(F.lit(1))
    return table.agg(n.alias("leaves"), F.max("n").alias("most_rows"), (F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))) + 1).cast("int").alias("depth"))
