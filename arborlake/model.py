"""Schemas, fixed codes and the voxel grid shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

# Fixed values of the node file format: node type codes and their printed names.
NODE_TYPE_LABELS = {
    0: "Undefined",
    1: "Soma",
    2: "Axon",
    3: "Basal dendrite",
    4: "Apical dendrite",
    5: "Custom",
    6: "Unspecified neurite",
    7: "Glia",
}
SOMA, AXON, BASAL, APICAL = 1, 2, 3, 4
DENDRITE_TYPES = (BASAL, APICAL)

# Fixed values of the regional profile.
LATERALITIES = ("ipsilateral", "contralateral", "midline", "unknown")
COMPARTMENTS = ("soma", "neurite")

# Fixed values of the flatmap projection: why a node has no position, and how it was looked up.
INVALID_CODES = {
    "": 0,
    "missing_input": 1,
    "out_of_bounds": 2,
    "invalid_flatmap": 3,
    "invalid_depth": 4,
}
LOOKUP_MODES = ("direct", "mirrored_depth", "mirrored", "unmapped")

# Fixed values of the cortical layer naming.
CORTICAL_LAYERS = ("L1", "L2/3", "L4", "L5", "L6a", "L6b")


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _D, _L = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType()

NODE_SCHEMA = _schema(
    ("file_id", _S), ("node_id", _I), ("type", _I), ("x", _D), ("y", _D), ("z", _D),
    ("radius", _D), ("parent_id", _I), ("region_id", _I), ("region_name", _S),
    ("region_acronym", _S), ("subject", _S), ("neuron_id", _S),
)
PROFILE_SCHEMA = _schema(
    ("file_id", _S), ("region_id", _I), ("laterality", _S), ("compartment", _S),
    ("cable_length_um", _D), ("node_count", _L), ("terminus_count", _L),
)
POINT_REQUIRED = ("label", "x", "y", "z")
POINT_OPTIONAL = ("region_name", "acronym", "id", "hemisphere")
ORIGIN_MISSING = "(not recorded)"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """True for a stored number that is neither NaN nor infinite; never null."""
    value = col(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def all_finite(*values: Column | str) -> Column:
    test = finite(values[0])
    for value in values[1:]:
        test = test & finite(value)
    return test


# 21 bits per axis: enough for ±1,048,576 voxels on each axis around the origin.
_AXIS_BITS = 21
_AXIS_HALF = 1 << (_AXIS_BITS - 1)


@dataclass(frozen=True)
class Grid:
    """A voxel grid: axis 0 follows x, axis 1 follows y, axis 2 follows z."""

    shape: tuple[int, int, int]
    resolution: tuple[float, float, float]
    midline_um: float = 5700.0
    lr_axis: int = 2

    @classmethod
    def cubic(cls, shape: Sequence[int], resolution: float, midline_um: float | None = None, lr_axis: int = 2):
        size = tuple(int(v) for v in shape)
        mid = size[lr_axis] * float(resolution) / 2 if midline_um is None else float(midline_um)
        return cls(size, (float(resolution),) * 3, mid, lr_axis)

    @property
    def extent(self) -> tuple[float, float, float]:
        return tuple(n * r for n, r in zip(self.shape, self.resolution))

    @property
    def mirror_point(self) -> float:
        """Centre of the voxel centres on the left-right axis."""
        return (self.shape[self.lr_axis] - 1) * self.resolution[self.lr_axis] / 2

    def floor_index(self, x="x", y="y", z="z") -> tuple[Column, Column, Column]:
        return tuple(F.floor(col(c) / F.lit(r)) for c, r in zip((x, y, z), self.resolution))

    def holds(self, ai="ai", bi="bi", ci="ci") -> Column:
        a, b, c = col(ai), col(bi), col(ci)
        return (
            (a >= 0) & (a < self.shape[0]) & (b >= 0) & (b < self.shape[1]) & (c >= 0) & (c < self.shape[2])
        )

    def linear(self, ai="ai", bi="bi", ci="ci") -> Column:
        _, nb, nc = self.shape
        return (col(ai).cast("long") * nb + col(bi).cast("long")) * nc + col(ci).cast("long")

    def box(self, x="x", y="y", z="z") -> Column:
        """Literal bounds of the grid, so that they reach the Parquet scan."""
        test = F.lit(True)
        for name, high in zip((x, y, z), self.extent):
            test = test & (col(name) >= 0.0) & (col(name) < float(high))
        return test


def resolution3(resolution: float | Sequence[float]) -> tuple[float, float, float]:
    values = (resolution,) * 3 if isinstance(resolution, (int, float)) else tuple(resolution)
    if len(values) != 3 or any(not v > 0 for v in values):
        raise ValueError("resolution needs one or three positive numbers")
    return tuple(float(v) for v in values)


def pack_voxel(ai: Column, bi: Column, ci: Column) -> Column:
    """One exact long per voxel; an index outside the 21-bit range is an error, never an alias."""
    inside = F.lit(True)
    for axis in (ai, bi, ci):
        inside = inside & axis.between(-_AXIS_HALF, _AXIS_HALF - 1)
    parts = [(axis.cast("long") + F.lit(_AXIS_HALF).cast("long")) for axis in (ai, bi, ci)]
    packed = F.shiftleft(parts[0], 2 * _AXIS_BITS).bitwiseOR(F.shiftleft(parts[1], _AXIS_BITS)).bitwiseOR(parts[2])
    return F.when(inside, packed).otherwise(F.raise_error(F.lit("voxel index beyond 21 bits")).cast("long"))


def unpack_voxel(voxel: Column | str) -> tuple[Column, Column, Column]:
    key, mask = col(voxel), (1 << _AXIS_BITS) - 1
    return tuple(
        F.shiftright(key, shift).bitwiseAND(F.lit(mask).cast("long")) - _AXIS_HALF
        for shift in (2 * _AXIS_BITS, _AXIS_BITS, 0)
    )
