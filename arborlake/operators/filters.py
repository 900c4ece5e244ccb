"""Row filters on nodes, somas and neuron tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import order_statistics
from ..model import DENDRITE_TYPES, SOMA, Grid, all_finite
from ..session import keep_keys, lookup_join, union_all
from .catalog import dendrite_coverage, inside_voxels, voxel_of

scope_filter = keep_keys


def voxel_mask_filter(nodes: DataFrame, grid: Grid, include: DataFrame | None = None, exclude: DataFrame | None = None):
    """Rows off the grid fail an include mask and pass an exclude mask."""
    if include is not None:
        nodes = inside_voxels(nodes, grid, include)
    if exclude is not None:
        nodes = inside_voxels(nodes, grid, exclude, keep=False)
    return nodes


def soma_mask_filter(centroids: DataFrame, grid: Grid, include: DataFrame) -> DataFrame:
    return inside_voxels(centroids, grid, include)


@dataclass(frozen=True)
class ExclusionRule:
    """Drop neurons with at least ``minimum`` nodes of ``types`` inside ``voxels``."""

    voxels: DataFrame
    types: tuple[int, ...]
    minimum: int = 1


def soma_exclusion_rules(nodes: DataFrame, grid: Grid, rules: Sequence[ExclusionRule]) -> DataFrame:
    """Files dropped by any rule. One scan: each mask voxel carries the numbers of its rules."""
    marked = union_all([
        r.voxels.filter(grid.holds()).select(grid.linear().alias("_voxel"), F.lit(i).alias("rule")) for i, r in enumerate(rules)
    ])
    by_voxel = marked.groupBy("_voxel").agg(F.collect_set("rule").alias("rules"))
    wanted = F.lit(False)
    enough = F.lit(False)
    for i, r in enumerate(rules):
        wanted = wanted | ((F.col("rule") == i) & F.col("type").isin(list(r.types)))
        enough = enough | ((F.col("rule") == i) & (F.col("n") >= r.minimum))
    every_type = sorted({t for r in rules for t in r.types})
    rows = voxel_of(nodes.filter(F.col("type").isin(every_type)).select("file_id", "node_id", "type", "x", "y", "z"), grid)
    hits = lookup_join(rows, by_voxel, "_voxel", salt_by=["file_id", "node_id"])
    return (
        hits.select("file_id", "type", F.explode("rules").alias("rule")).filter(wanted)
        .groupBy("rule", "file_id").agg(F.count(F.lit(1)).alias("n")).filter(enough).select("file_id").distinct()
    )


def node_type_filter(nodes: DataFrame, mode: str = "all", types: Iterable[int] = ()) -> DataFrame:
    hit = F.col("type").isin([int(t) for t in types])
    if mode == "all":
        return nodes
    if mode == "include":
        return nodes.filter(hit)
    if mode == "exclude":
        return nodes.filter(F.col("type").isNull() | ~hit)
    raise ValueError(f"unknown mode {mode!r}")


def require_dendrites(nodes: DataFrame, whole: DataFrame, types: Iterable[int] = DENDRITE_TYPES) -> DataFrame:
    """Keep nodes of files that have a dendrite label anywhere in the unfiltered table."""
    files = dendrite_coverage(whole, types).filter("labelled").select("file_id")
    return lookup_join(nodes, files, "file_id", "left_semi", salt_by=["node_id"], check=False)


def _with_soma(nodes: DataFrame, whole: DataFrame, finite_only: bool):
    somas = whole.filter(F.col("type") == SOMA)
    if finite_only:
        somas = somas.filter(all_finite("x", "y", "z"))
    centres = somas.groupBy("file_id").agg(*[F.avg(c).alias(f"_soma_{c}") for c in "xyz"])
    joined = lookup_join(nodes, centres, "file_id", salt_by=["node_id"], check=False)
    squares = [F.pow(F.col(c) - F.col(f"_soma_{c}"), F.lit(2.0)) for c in "xyz"]
    return joined, squares[0] + squares[1] + squares[2]


def exclude_near_soma(nodes: DataFrame, whole: DataFrame, radius_um: float) -> DataFrame:
    """Keep nodes strictly farther than the radius; files without a finite soma vanish."""
    joined, squared = _with_soma(nodes, whole, finite_only=True)
    return joined.filter(squared > F.lit(float(radius_um) ** 2)).select(*nodes.columns)


def within_soma_radius(nodes: DataFrame, whole: DataFrame, radius_um: float) -> DataFrame:
    joined, squared = _with_soma(nodes, whole, finite_only=False)
    return joined.filter(F.sqrt(squared) <= F.lit(float(radius_um))).select(*nodes.columns)


@dataclass(frozen=True)
class VoxelNodeFilter:
    """Node filter used before counting voxels; every part is judged on the unfiltered neurons."""

    mode: str = "all"
    types: tuple[int, ...] = ()
    require_dendrites: bool = False
    exclude_within_soma_um: float | None = None

    def apply(self, nodes: DataFrame, whole: DataFrame) -> DataFrame:
        if self.require_dendrites:
            nodes = require_dendrites(nodes, whole)
        if self.exclude_within_soma_um is not None:
            nodes = exclude_near_soma(nodes, whole, self.exclude_within_soma_um)
        return node_type_filter(nodes, self.mode, self.types)


@dataclass(frozen=True)
class AnnotationRule:
    """Exact label, tag match any/all/exact, tag count any/single/multiple, excluded tags.

    ``tags=None`` is no restriction and ``tags=''`` means untagged.
    """

    label: str | None = None
    tags: str | tuple[str, ...] | None = None
    match: str = "all"
    count: str = "any"
    excluded: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.match not in ("any", "all", "exact") or self.count not in ("any", "single", "multiple"):
            raise ValueError("unsupported tag rule")


def _texts(values: Iterable[str]):
    return F.array(*[F.lit(v) for v in sorted(set(values))]).cast("array<string>")


def annotation_test(rule: AnnotationRule) -> Column:
    """The rule as a condition on a label text and a ``tags`` array."""
    tags = F.array_distinct(F.coalesce(F.col("tags"), F.array().cast("array<string>")))
    test = F.lit(True)
    if rule.label is not None:
        test = test & (F.col("label") == rule.label)
    if rule.excluded:
        test = test & ~F.arrays_overlap(tags, _texts(rule.excluded))
    if rule.count == "single":
        test = test & (F.size(tags) == 1)
    elif rule.count == "multiple":
        test = test & (F.size(tags) >= 2)
    if rule.tags == "":
        test = test & (F.size(tags) == 0)
    elif rule.tags is not None:
        wanted = _texts([rule.tags] if isinstance(rule.tags, str) else rule.tags)
        missing = F.size(F.array_except(wanted, tags)) == 0
        if rule.match == "any":
            test = test & F.arrays_overlap(wanted, tags)
        elif rule.match == "all":
            test = test & missing
        else:
            test = test & missing & (F.size(F.array_except(tags, wanted)) == 0)
    return test


def annotation_filter(entries: DataFrame, rule: AnnotationRule) -> DataFrame:
    return entries.filter(annotation_test(rule))


def cluster_filter(table: DataFrame, clusters: Iterable[int] = (), unclustered: bool = False, all_clusters: bool = False):
    """Nothing chosen keeps every row."""
    ids, label = [int(c) for c in clusters], F.col("label")
    if not ids and not unclustered and not all_clusters:
        return table
    test = label.isNotNull() if all_clusters else label.isNotNull() & label.isin(ids)
    return table.filter((test | label.isNull()) if unclustered else test)


def slab_somas(nodes: DataFrame, axis: str, position: float, tolerance: float) -> DataFrame:
    near = F.col(axis).between(float(position - tolerance), float(position + tolerance))
    return nodes.filter((F.col("type") == SOMA) & near)


# Fixed values of the anatomical planes: hidden, vertical and horizontal axis.
PLANES = {"coronal": ("x", "y", "z"), "horizontal": ("y", "x", "z"), "sagittal": ("z", "y", "x")}


def project_plane(
    centroids: DataFrame, plane: str, slab: bool = False, position: float | None = None, thickness: float | None = None,
    default_thickness: float = 1.0,
) -> DataFrame:
    """Soma centroids as (horizontal, vertical); a slab without a position sits at the median."""
    hidden, vertical, horizontal = PLANES[plane]
    rows = centroids.filter(all_finite("x", "y", "z"))
    if slab:
        if position is None:
            n = rows.count()
            middle = order_statistics(rows, hidden, [(n - 1) // 2, n // 2]) if n else [0.0, 0.0]
            position = (middle[0] + middle[1]) / 2
        width = thickness if thickness and thickness > 0 else max(default_thickness, 2.220446049250313e-16)
        rows = rows.filter(F.abs(F.col(hidden) - F.lit(float(position))) <= F.lit(width / 2))
    return rows.select("file_id", F.col(horizontal).alias("horizontal"), F.col(vertical).alias("vertical"))
