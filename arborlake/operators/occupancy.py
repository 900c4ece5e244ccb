"""Region occupancy of flatmap bins: labels, outlines, faces and components."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clamp
from ..functions.ranks import number_rows
from ..model import Grid, finite
from .components import connected_components
from .flatmap import FlatGrid, _axis_bin, _selected, lookup_valid
from .stencil import beside
from .volumes import VOXEL

ZYX = ("z", "y", "x")


def occupancy(
    annotation: DataFrame, lookup: DataFrame, volume: Grid, grid: FlatGrid, mirror_depth: bool = True, mirror_axis: int = 2,
    zero_sentinel: bool = False, negative_one_sentinel: bool = True,
) -> DataFrame:
    """(region_id, linear_bin, n): source voxels per region and flatmap bin.

    A missing depth may come from the mirrored voxel. Both inputs are volumes of one atlas, joined voxel by voxel.
    """
    rows = lookup.filter(volume.holds()).select(*VOXEL, "x_flat", "y_flat", "depth_um")
    good = finite("depth_um") & (F.col("depth_um") >= 0)
    if mirror_depth:
        axis = VOXEL[mirror_axis]
        other = rows.filter(good).select(
            *[v for v in VOXEL if v != axis], (F.lit(volume.shape[mirror_axis] - 1) - F.col(axis)).alias(axis),
            F.col("depth_um").alias("_other"),
        )
        rows = rows.join(other, list(VOXEL), "left").withColumn("depth_um", F.when(good, F.col("depth_um")).otherwise(F.col("_other")))
    rows = rows.filter(lookup_valid(zero_sentinel, negative_one_sentinel) & good)
    depth = F.floor((F.col("depth_um") - F.lit(grid.depth_bounds[0])) / F.lit(grid.depth_bin_um))
    linear = clamp(depth, 0, grid.valid_depth_bins - 1) * grid.plane_size + (
        _axis_bin("y_flat", grid.y_bounds, grid.y_bins) * grid.x_bins + _axis_bin("x_flat", grid.x_bounds, grid.x_bins)
    )
    joined = annotation.filter("region_id > 0").join(rows, list(VOXEL))
    return joined.groupBy("region_id", linear.alias("linear_bin")).agg(F.count(F.lit(1)).alias("n"))


def majority_label(counts: DataFrame, bin_name: str = "linear_bin") -> DataFrame:
    """Per bin the region with most voxels, the smaller id on a tie, and whether several regions compete.

    A fold over (count, id) pairs: no bin is gathered or sorted.
    """
    best = F.max(F.struct("n", (-F.col("region_id")).alias("m")))
    return counts.groupBy(bin_name).agg(best.alias("b"), F.count(F.lit(1)).alias("c")).select(
        bin_name, (-F.col("b.m")).alias("region_id"), F.col("b.n").alias("n"), (F.col("c") > 1).alias("collision")
    )


def _chosen(table: DataFrame, region_ids: Iterable[int] | None) -> DataFrame:
    return table if region_ids is None else table.filter(F.col("region_id").isin([int(r) for r in region_ids]))


def flat_occupancy(table: DataFrame, grid: FlatGrid) -> DataFrame:
    """Counts summed over depth, so that a region's own depth bins do not compete."""
    return table.groupBy("region_id", (F.col("linear_bin") % grid.plane_size).alias("linear_bin")).agg(F.sum("n").alias("n"))


def region_labels_3d(table: DataFrame, region_ids: Iterable[int] | None = None) -> DataFrame:
    return majority_label(_chosen(table, region_ids))


def region_labels_flat(table: DataFrame, grid: FlatGrid, region_ids: Iterable[int] | None = None) -> DataFrame:
    return majority_label(flat_occupancy(_chosen(table, region_ids), grid))


def region_labels_layers(
    table: DataFrame, grid: FlatGrid, layers: DataFrame, selected: Sequence[int] | None = None, stack: bool = True
) -> DataFrame:
    """Majority label per layer plane, or on one plane for all chosen layers."""
    chosen = _selected(selected)
    plane = (F.array_position(F.array(*[F.lit(i) for i in chosen]), F.col("layer_index")) - 1).cast("long")
    flat = flat_occupancy(table, grid).join(layers.filter(F.col("layer_index").isin(chosen)), "region_id")
    place = plane * grid.plane_size + F.col("linear_bin") if stack else F.col("linear_bin")
    return majority_label(flat.select("region_id", place.alias("linear_bin"), "n"))


def selection_groups(members: DataFrame, closure: DataFrame, roots: Sequence[int]) -> DataFrame:
    """(root, region_id): each occupied region goes to the deepest selected root above it.

    The deepest root is the one with the fewest descendants, the smaller id on a tie.
    """
    chosen = closure.filter(F.col("ancestor_region_id").isin([int(r) for r in roots])).select(
        F.col("ancestor_region_id").alias("root"), F.col("direct_region_id").alias("region_id")
    )
    sizes = chosen.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    best = F.min(F.struct("size", "root"))
    owners = chosen.join(sizes, "root").groupBy("region_id").agg(best.alias("b")).select("region_id", F.col("b.root").alias("root"))
    return owners.join(members.select("region_id").distinct(), "region_id", "left_semi").select("root", "region_id")


def region_bins(table: DataFrame, grid: FlatGrid, groups: DataFrame | None = None, flat: bool = False) -> DataFrame:
    """(region_id, z, y, x): the distinct bins of each region, or of each group's union."""
    rows = flat_occupancy(table, grid) if flat else table
    if groups is not None:
        rows = rows.join(groups, "region_id").drop("region_id").withColumnRenamed("root", "region_id")
    plane, rest = F.col("linear_bin"), F.col("linear_bin") % grid.plane_size
    return rows.select("region_id", "linear_bin").distinct().select(
        "region_id", F.floor(plane / F.lit(grid.plane_size)).alias("z"), F.floor(rest / F.lit(grid.x_bins)).alias("y"),
        (rest % grid.x_bins).alias("x"),
    )


# Fixed values of the outline: neighbour direction, start of the edge seen from the bin centre, edge vector.
OUTLINE_EDGES = [
    ((0, -1, 0), (0.0, -0.5, -0.5), (0.0, 0.0, 1.0)),
    ((0, 1, 0), (0.0, 0.5, 0.5), (0.0, 0.0, -1.0)),
    ((0, 0, -1), (0.0, 0.5, -0.5), (0.0, -1.0, 0.0)),
    ((0, 0, 1), (0.0, -0.5, 0.5), (0.0, 1.0, 0.0)),
]

# Fixed values of the surface: neighbour direction and the four corners of the face in winding order.
SURFACE_FACES = [
    ((-1, 0, 0), ((-0.5, -0.5, -0.5), (-0.5, -0.5, 0.5), (-0.5, 0.5, 0.5), (-0.5, 0.5, -0.5))),
    ((1, 0, 0), ((0.5, -0.5, -0.5), (0.5, 0.5, -0.5), (0.5, 0.5, 0.5), (0.5, -0.5, 0.5))),
    ((0, -1, 0), ((-0.5, -0.5, -0.5), (0.5, -0.5, -0.5), (0.5, -0.5, 0.5), (-0.5, -0.5, 0.5))),
    ((0, 1, 0), ((-0.5, 0.5, -0.5), (-0.5, 0.5, 0.5), (0.5, 0.5, 0.5), (0.5, 0.5, -0.5))),
    ((0, 0, -1), ((-0.5, -0.5, -0.5), (-0.5, 0.5, -0.5), (0.5, 0.5, -0.5), (0.5, -0.5, -0.5))),
    ((0, 0, 1), ((-0.5, -0.5, 0.5), (0.5, -0.5, 0.5), (0.5, 0.5, 0.5), (-0.5, 0.5, 0.5))),
]


def _open_sides(bins: DataFrame, directions: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(region_id, z, y, x, way): sides of bins whose neighbour in that direction is not of the same region."""
    return beside(bins, ZYX, directions, group="region_id")


def _literal(values: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in values])


def region_outlines(bins: DataFrame) -> DataFrame:
    """In-plane boundary edges per region: start point and direction in bin coordinates."""
    sides = _open_sides(bins, [d for d, _, _ in OUTLINE_EDGES])
    pick = lambda table, i: F.element_at(F.element_at(_literal(table), F.col("way") + 1), i + 1)
    starts, vectors = [s for _, s, _ in OUTLINE_EDGES], [v for _, _, v in OUTLINE_EDGES]
    return sides.select(
        "region_id", *[(F.col(n) + pick(starts, i)).alias(n) for i, n in enumerate(ZYX)],
        *[pick(vectors, i).alias(f"d{n}") for i, n in enumerate(ZYX)],
    )


def exposed_faces(bins: DataFrame) -> DataFrame:
    """(region_id, z, y, x, way): bin faces without a neighbour of the same region."""
    return _open_sides(bins, [d for d, _ in SURFACE_FACES])


def region_faces(bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) per region, corners welded: equal corner positions share a vertex number.

    Vertices are numbered from 0 within their region in (z, y, x) order, by ranges rather than by a window that
    would hold a whole region.
    """
    faces = exposed_faces(bins)
    corners = F.array(*[
        F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(ZYX, corner)]) for corner in c]) for _, c in SURFACE_FACES
    ])
    four = faces.withColumn("_c", F.element_at(corners, F.col("way") + 1)).select(
        "region_id", "way", *[F.col(n).alias(f"_{n}") for n in ZYX], F.posexplode("_c").alias("corner", "_p")
    ).select(
        "region_id", "way", "_z", "_y", "_x", "corner", *[(F.col(f"_{n}") + F.col(f"_p.{n}")).alias(f"v{n}") for n in ZYX]
    )
    keys = ["region_id", "vz", "vy", "vx"]
    numbered = number_rows(four.select(*keys).distinct(), keys, "_all")
    first = numbered.groupBy("region_id").agg(F.min("_all").alias("_first"))
    vertices = numbered.join(first, "region_id").select(*keys, (F.col("_all") - F.col("_first")).alias("vertex"))
    face = ["region_id", "way", "_z", "_y", "_x"]
    at = lambda i: F.max(F.when(F.col("corner") == i, F.col("vertex"))).alias(f"c{i}")
    quads = four.join(vertices, keys).groupBy(*face).agg(*[at(i) for i in range(4)])
    two = F.array(F.struct(F.col("c0").alias("a"), F.col("c1").alias("b"), F.col("c2").alias("c")),
                  F.struct(F.col("c0").alias("a"), F.col("c2").alias("b"), F.col("c3").alias("c")))
    return vertices, quads.select("region_id", F.explode(two).alias("t")).select("region_id", "t.a", "t.b", "t.c")


def region_components(bins: DataFrame) -> DataFrame:
    """Number of 6-connected components per region. Only forward neighbours are linked."""
    key = F.struct("region_id", *ZYX)
    forward = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    step = lambda k: F.element_at(F.array(*[F.lit(f[k]).cast("long") for f in forward]), F.col("way") + 1)
    links = beside(bins, ZYX, forward, group="region_id", present=True).select(
        key.alias("src"), F.struct("region_id", *[(F.col(n) + step(k)).alias(n) for k, n in enumerate(ZYX)]).alias("dst")
    )
    found = connected_components(bins.select(key.alias("id")), links)
    return found.select(F.col("component.region_id").alias("region_id"), "component").distinct().groupBy("region_id").agg(
        F.count(F.lit(1)).alias("components")
    )
