"""Region hierarchy, annotation lookups, region masks and cortical layers."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import path_ids
from ..functions.ranks import number_rows
from ..model import CORTICAL_LAYERS, Grid, all_finite
from ..session import forget, lookup_join, settle, union_all
from .blocks import BlockVolume, at_voxels
from .stencil import beside, offsets_to_nearest
from .volumes import VOXEL, mask_union


def with_paths(structures: DataFrame) -> DataFrame:
    """Ids root → region as an array without repeats, the region itself last."""
    kind = dict(structures.dtypes)["structure_id_path"]
    ids = F.array_distinct(F.coalesce(path_ids("structure_id_path", kind), F.array().cast("array<int>")))
    own = F.array(F.col("id").cast("int"))
    path = F.when(F.try_element_at(ids, F.lit(-1)) == F.col("id"), ids).otherwise(F.concat(ids, own))
    return structures.withColumn("path", path)


def structures_closure(structures: DataFrame) -> DataFrame:
    """(ancestor, direct, depth) with every region as its own ancestor at depth 0."""
    rows = with_paths(structures).select("id", "path", F.posexplode("path").alias("pos", "ancestor"))
    return rows.select(
        F.col("ancestor").alias("ancestor_region_id"), F.col("id").cast("int").alias("direct_region_id"),
        (F.size("path") - F.col("pos") - 1).cast("int").alias("depth"),
    ).distinct().orderBy("ancestor_region_id", "direct_region_id", "depth")


def annotate_regions(nodes: DataFrame, annotation: DataFrame | BlockVolume, structures: DataFrame, grid: Grid) -> DataFrame:
    """Region id, name and acronym per node: voxel by truncation toward zero, 0 outside.

    ``annotation`` is a sparse volume or one in blocks of ``region_id``, written once for many calls.
    """
    index = [(F.col(c) / F.lit(r)).cast("long") for c, r in zip("xyz", grid.resolution)]
    inside = all_finite("x", "y", "z")
    rows = nodes.drop("region_id", "region_name", "region_acronym").withColumn(
        "_voxel", F.when(inside & grid.holds(*[F.when(inside, i) for i in index]), grid.linear(*[F.when(inside, i) for i in index]))
    )
    volume = annotation
    if isinstance(annotation, DataFrame):
        volume = annotation.filter(grid.holds() & (F.col("region_id") != 0)).select(grid.linear().alias("_voxel"), "region_id")
    names = structures.select(
        F.col("id").alias("region_id"), F.col("name").alias("region_name"), F.col("acronym").alias("region_acronym")
    )
    found = at_voxels(rows, "_voxel", volume, grid, ["region_id"], salt_by=["file_id", "node_id"])
    labelled = found.drop("_voxel").withColumn("region_id", F.coalesce("region_id", F.lit(0)))
    return lookup_join(labelled, names, "region_id", "left", salt_by=["file_id", "node_id"])


def represented_regions(region_ids: DataFrame, closure: DataFrame) -> DataFrame:
    """Regions seen in the data and their ancestors; unknown ids are ignored."""
    seen = region_ids.select(F.col("region_id").alias("direct_region_id")).distinct()
    return closure.join(seen, "direct_region_id", "left_semi").select(F.col("ancestor_region_id").alias("region_id")).distinct()


def region_descendants(closure: DataFrame, region_ids: Iterable[int]) -> DataFrame:
    chosen = closure.filter(F.col("ancestor_region_id").isin([int(r) for r in region_ids]))
    return chosen.select(F.col("ancestor_region_id").alias("selected_id"), F.col("direct_region_id").alias("region_id"))


def ancestor_paths(structures: DataFrame, region_ids: Iterable[int]) -> DataFrame:
    """(region, position, ancestor) from root to leaf."""
    rows = with_paths(structures).filter(F.col("id").isin([int(r) for r in region_ids]))
    return rows.select(F.col("id").alias("region_id"), F.posexplode("path").alias("position", "ancestor_id"))


def region_mask(annotation: DataFrame, closure: DataFrame, region_ids: Iterable[int]) -> DataFrame:
    """Voxels of the regions and all their descendants."""
    direct = region_descendants(closure, region_ids).select("region_id").distinct()
    return lookup_join(annotation, direct, "region_id", "left_semi", salt_by=list(VOXEL)).select(*VOXEL)


def ids_of(structures: DataFrame, acronyms: Sequence[str]) -> list[int]:
    """Ids of a short list of acronyms, in that order; an unknown acronym is an error."""
    found = {r["acronym"]: r["id"] for r in structures.filter(F.col("acronym").isin(list(acronyms))).collect()}
    missing = [a for a in acronyms if a not in found]
    if missing:
        raise ValueError(f"unknown acronyms {missing}")
    return [found[a] for a in acronyms]


_FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _distances(mask: DataFrame, boundary: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Distance of each voxel outside the mask to its nearest mask voxel, up to the radius."""
    found = offsets_to_nearest(boundary, grid, radius, VOXEL)
    square = [F.pow(F.col(d) * s, F.lit(2.0)) for d, s in zip(("da", "db", "dc"), grid.resolution)]
    near = found.select(*VOXEL, F.sqrt(square[0] + square[1] + square[2]).alias("d")).filter((F.col("d") > 0) & (F.col("d") <= F.lit(radius)))
    return near.join(mask, list(VOXEL), "left_anti")


def dilate_mask(
    mask: DataFrame, grid: Grid, fraction: float = 0.2, tolerance: float = 0.001, max_iterations: int = 60
) -> DataFrame:
    """Grow a mask by Euclidean distance until its volume has risen by the fraction.

    Distances start from boundary voxels (the nearest mask voxel of any outside voxel is one) and reach as far as the
    new voxels need if they lie evenly on the boundary, or else twice as far as before. The threshold is searched on the
    counts per distinct distance.
    """
    mask = settle(mask.select(*[F.col(v).cast("long").alias(v) for v in VOXEL]).distinct())
    volume = mask.count()
    if not volume:
        raise ValueError("cannot grow an empty mask")
    target = volume * (1.0 + float(fraction))
    sides = beside(mask, VOXEL, _FACES)
    step = [F.element_at(F.array(*[F.lit(f[k]) for f in _FACES]), F.col("way") + 1) for k in range(3)]
    sides = sides.filter(grid.holds(*[F.col(v) + s for v, s in zip(VOXEL, step)]))
    boundary = settle(sides.groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("sides")))
    diagonal = math.sqrt(sum(e * e for e in grid.extent))
    layers = (target - volume) / max(boundary.agg(F.sum("sides")).first()[0] or 1, 1)
    unit = max(grid.resolution)
    reach = unit * 2.0 ** max(0, math.ceil(math.log2(max(layers, 1.0))))
    while True:
        found = settle(_distances(mask, boundary, grid, reach))
        steps = sorted((r["d"], r["n"]) for r in found.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect())
        grown = lambda t: volume + sum(n for d, n in steps if d <= t)
        if grown(reach) >= target:
            break
        if reach > diagonal:
            raise ValueError("the grid is too small for the wanted volume")
        reach *= 2.0
        forget(found)
    # the search begins at the first doubling of a voxel's size that is far enough
    high = unit
    while grown(high) < target:
        high *= 2.0
    low, best, error = 0.0, high, abs(grown(high) - target)
    for _ in range(max_iterations):
        middle = 0.5 * (low + high)
        size = grown(middle)
        if abs(size - target) < error:
            best, error = middle, abs(size - target)
        if target * (1 - tolerance) <= size <= target * (1 + tolerance):
            best = middle
            break
        low, high = (middle, high) if size < target else (low, middle)
    return mask.unionByName(found.filter(F.col("d") <= F.lit(best)).select(*VOXEL))


def expanded_region_ids(annotation: DataFrame, closure: DataFrame, grid: Grid, region_ids: Sequence[int], fraction: float = 0.2):
    """(ai, bi, ci, voxel_id): the grown union of the regions, numbered in axis order."""
    mask = region_mask(annotation, closure, region_ids)
    if fraction > 0:
        mask = dilate_mask(mask, grid, fraction)
    return number_rows(mask, list(VOXEL), "voxel_id")


@dataclass(frozen=True)
class RegionRule:
    region_id: int
    include: bool = True
    dilation: float = 0.0


def region_rule_filter(annotation: DataFrame, closure: DataFrame, grid: Grid, rules: Sequence[RegionRule]):
    """(include union, exclude union); None for a role without rules."""
    out: dict[bool, list[DataFrame]] = {True: [], False: []}
    for rule in rules:
        mask = region_mask(annotation, closure, [rule.region_id])
        out[rule.include].append(dilate_mask(mask, grid, rule.dilation) if rule.dilation > 0 else mask)
    return tuple(mask_union(masks) if masks else None for masks in (out[True], out[False]))


def physical_midline(hemispheres: DataFrame, grid: Grid, codes: tuple[int, int] = (1, 2)) -> float:
    """Boundary where the two hemisphere codes meet on the left-right axis."""
    axis = VOXEL[grid.lr_axis]
    rows = hemispheres.filter(F.col("code").isin(list(codes))).groupBy("code").agg(
        F.min(axis).alias("lo"), F.max(axis).alias("hi")
    ).collect()
    spans = sorted((r["lo"], r["hi"]) for r in rows)
    if len(spans) != 2:
        raise ValueError("a hemisphere code is absent")
    if spans[0][1] >= spans[1][0]:
        raise ValueError("hemisphere codes overlap")
    if spans[0][1] + 1 != spans[1][0]:
        raise ValueError("hemisphere codes do not meet")
    return spans[1][0] * grid.resolution[grid.lr_axis]


# Fixed pattern of a layer token at the end of a region name.
LAYER_PATTERN = r"(?i)(?:,|/)\s*(?:layer\s+)?(2/3|6a|6b|1|4|5)\s*$"


def layer_map(structures: DataFrame, check: bool = True) -> DataFrame:
    """(region_id, layer_index, layer_label) for the terminal regions below the single Isocortex node."""
    rows = with_paths(structures)
    is_cortex = (F.lower(F.trim("acronym")) == "isocortex") | (F.lower(F.trim("name")) == "isocortex")
    cortex = [r["id"] for r in structures.filter(is_cortex).select("id").distinct().limit(2).collect()]
    if len(cortex) != 1:
        raise ValueError("exactly one Isocortex structure is needed")
    below = rows.filter(F.array_contains("path", cortex[0]))
    inner = below.select(F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("id")).distinct()
    token = F.lower(F.regexp_extract("name", LAYER_PATTERN, 1))
    keys = F.array(*[F.lit(label[1:].lower()) for label in CORTICAL_LAYERS])
    labels = F.array(*[F.lit(label) for label in CORTICAL_LAYERS])
    found = below.join(inner, "id", "left_anti").filter(token != "").select(
        F.col("id").alias("region_id"), (F.array_position(keys, token) - 1).cast("int").alias("layer_index")
    )
    found = found.withColumn("layer_label", F.element_at(labels, F.col("layer_index") + 1))
    if check:
        present = {r[0] for r in found.select("layer_label").distinct().collect()}
        missing = [label for label in CORTICAL_LAYERS if label not in present]
        if missing:
            raise ValueError(f"no terminal region for layers {missing}")
    return found


def layer_hierarchy(structures: DataFrame, layers: DataFrame) -> DataFrame:
    """Rows of the tree layers → layer → terminal region, in display order."""
    named = layers.join(structures.select(F.col("id").alias("region_id"), "name", "acronym"), "region_id")
    return named.select("layer_index", "layer_label", "region_id", "name", "acronym").orderBy(
        "layer_index", F.lower("name"), F.lower("acronym"), "region_id"
    )
