"""Cell numbers and space-filling keys as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapoint.types import ConfigError


def grid_cell(x: Column, size: float, origin: float = 0.0) -> Column:
    """Number of the half-open cell that holds x; all of the axis is cell 0 when the size is 0."""
    return F.floor((x - origin) / size) if size else F.lit(0).cast("long")


def cell_range(lo: Column, hi: Column, size: float, origin: float = 0.0) -> tuple[Column, Column]:
    """(first, last) cell that the closed interval lo..hi meets; of a box, one pair an axis."""
    return grid_cell(lo, size, origin), grid_cell(hi, size, origin)


def default_cell_size(span: float, rows: int, dims: int) -> float:
    """About one row a cell on a uniform axis, 1.0 at least."""
    return max(span / max(rows, 1) ** (1 / dims), 1.0)


def quadrant(coords: list[Column], mid: list[Column]) -> Column:
    """Bit d is set where coordinate d reaches the middle."""
    return reduce(Column.__add__, [F.when(x >= m, F.lit(1 << d)).otherwise(F.lit(0)) for d, (x, m) in enumerate(zip(coords, mid, strict=True))])


def default_order(dims: int) -> int:
    """Bits an axis within a key of 128 bits: 32 where they fit, else 16 at most."""
    most = 128 // dims
    return 32 if most >= 32 else min(most, 16)


def layout_order(dims: int) -> int:
    """Bits an axis for keys that order a layout: 16 at most, and within a long."""
    return min(128 // dims, 16, 63 // dims)


def normalised(x: Column, lo: float, hi: float, order: int) -> Column:
    """x on the axis lo..hi as a whole number of `order` bits, clamped."""
    span, top = (hi - lo) or 1.0, (1 << order) - 1
    return F.greatest(F.lit(0.0), F.least(F.floor((x - lo) / span * float(1 << order)).cast("double"), F.lit(float(top)))).cast("long")


def z_key(cells: list[Column], order: int) -> Column:
    """Interleaved bits: whole quadrants share a prefix."""
    dims = len(cells)
    if dims * order > 63:
        raise ConfigError("a z key of over 63 bits")
    bits = [F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), i * dims + d) for i in range(order) for d, c in enumerate(cells)]
    return reduce(Column.bitwiseOR, bits)


def curve_key(cells: list[Column], order: int) -> Column:
    """Position along the library's space-filling curve, as a long.

    One step a bit from the highest down: the bits of all axes, less the state and turned by it, are the child; the
    child's digits are appended and decide the next state. The fold keeps state and key together, so every step is
    written once, and single-element transforms name a step's parts."""
    dims = len(cells)
    if dims * order > 63:
        raise ConfigError("a curve key of over 63 bits; lower the order")
    mask = (1 << dims) - 1
    one = F.lit(1).cast("long")

    def turned(bits: Column, by: Column) -> Column:
        """bits turned right by `by` (0 .. dims - 1) inside dims bits."""
        cases = bits
        for n in range(1, dims):
            cases = F.when(by == n, F.shiftright(bits, n).bitwiseOR(F.shiftleft(bits, dims - n)).bitwiseAND(F.lit(mask))).otherwise(cases)
        return cases

    def ungray(n: Column) -> Column:
        out = n
        for shift in range(1, dims):
            out = out.bitwiseXOR(F.shiftright(n, shift))
        return out

    def trailing(n: Column) -> Column:
        """Trailing zero bits of n (1 .. 2^dims), modulo dims."""
        out = F.lit(0)
        for z in range(1, dims + 1):
            out = F.when(F.pmod(n, F.lit(1 << z)) == 0, F.lit(z % dims)).otherwise(out)
        return out

    kept = F.array(*[c.cast("long").bitwiseAND(F.lit((1 << order) - 1).cast("long")) for c in cells])

    def step(acc: Column, bit: Column) -> Column:
        entry = F.aggregate(F.zip_with(kept, F.array(*[F.lit(1 << d).cast("long") for d in range(dims)]), lambda c, w: F.pmod(F.floor(c / F.pow(F.lit(2.0), bit)), F.lit(2)) * w), F.lit(0).cast("long"), lambda a, b: a + b)
        child = turned(entry.bitwiseXOR(acc["state"]), F.pmod(acc["state"], F.lit(dims)))

        def after(c: Column) -> Column:
            mixed = acc["state"].bitwiseXOR(ungray(c)).bitwiseAND(F.lit(mask).cast("long"))
            return F.struct((F.shiftleft(acc["key"], dims) + c).cast("long").alias("key"), turned(mixed, trailing(c + one)).cast("long").alias("state"))

        return F.transform(F.array(child), after)[0]

    start = F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("state"))
    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["key"])
