"""A space-filling order of voxels: numbers whose bits are those of the three axes by turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..model import Grid, all_finite

AXIS_BITS = 20
#: Ranges of numbers that a filter may hold.
RANGES = 64
# Fixed values of bit spreading: shift, and the bits that stay.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(axis: Column) -> Column:
    """Bit k of the axis as bit 3k."""
    out = axis.cast("long")
    for shift, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def morton(ai: Column, bi: Column, ci: Column) -> Column:
    """The number of a voxel; null for an index outside 0 to 2^20 - 1."""
    inside = F.lit(True)
    for axis in (ai, bi, ci):
        inside = inside & axis.between(0, (1 << AXIS_BITS) - 1)
    parts = [F.shiftleft(_spread(axis), k) for k, axis in ((2, ai), (1, bi), (0, ci))]
    return F.when(inside, parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]))


def node_morton(grid: Grid) -> Column:
    """The number of a node's voxel; null where a coordinate is not finite or lies outside the numbers."""
    return F.when(all_finite("x", "y", "z"), morton(*grid.floor_index()))


def ranges_of(voxels: DataFrame, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges (first, last) of numbers that hold all the voxels.

    Cubes of 1, 2, 4 … voxels a side are runs of numbers; the finest size with few enough of them is taken and runs that touch
    become one.
    """
    code = morton(*[F.col(v) for v in ("ai", "bi", "ci")])
    numbers = voxels.select(code.alias("code")).filter("code IS NOT NULL")
    levels = range(AXIS_BITS + 1)
    counts = numbers.agg(*[F.approx_count_distinct(F.shiftright("code", 3 * k), 0.02).alias(f"l{k}") for k in levels]).first()
    for k in levels:
        if counts[k] > 2 * most:
            continue
        cells = sorted(r[0] for r in numbers.select(F.shiftright("code", 3 * k).alias("cell")).distinct().limit(4 * most).collect())
        runs: list[list[int]] = []
        for cell in cells:
            if runs and runs[-1][1] + 1 == cell:
                runs[-1][1] = cell
            else:
                runs.append([cell, cell])
        if len(runs) <= most and len(cells) < 4 * most:
            return [(a << 3 * k, ((b + 1) << 3 * k) - 1) for a, b in runs]
    return []


def in_ranges(column: str, ranges: list[tuple[int, int]]) -> Column:
    test = F.lit(False)
    for first, last in ranges:
        test = test | F.col(column).between(first, last)
    return test
