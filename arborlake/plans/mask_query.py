"""Neurons with a node inside a set of voxel masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..model import Grid, all_finite
from ..operators.catalog import along_curve, inside_voxels
from ..operators.filters import node_type_filter
from ..operators.volumes import VOXEL, mask_union
from ..session import keep_keys


def mask_box(nodes: DataFrame, grid: Grid, mask: DataFrame) -> DataFrame:
    """Literal coordinate bounds of the mask: they reach the scan, which skips row groups by their statistics."""
    row = mask.agg(*[f(v).alias(f"{v}_{n}") for v in VOXEL for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    if row["ai_lo"] is None:
        return nodes.filter(F.lit(False))
    test = F.lit(True)
    for name, axis, step in zip("xyz", VOXEL, grid.resolution):
        test = test & (F.col(name) >= float(row[f"{axis}_lo"] * step)) & (F.col(name) < float((row[f"{axis}_hi"] + 1) * step))
    return nodes.filter(test)


def near_mask(nodes: DataFrame, grid: Grid, mask: DataFrame) -> DataFrame:
    """Nodes that may lie in the mask, by filters that reach the scan: its bounding box, and in a table written along a
    space-filling curve over the same grid (``write_spatial_nodes``) the ranges of the curve that the mask covers."""
    return mask_box(along_curve(nodes, mask), grid, mask)


def neurons_in_masks(
    nodes: DataFrame, grid: Grid, masks: Sequence[DataFrame], file_ids=None, exclude_file_ids=None, node_types=None
) -> DataFrame:
    """Distinct neurons with an eligible node in the union of the masks; display names are the smallest seen."""
    mask = mask_union(masks).filter(grid.holds())
    rows = near_mask(nodes, grid, mask).select("file_id", "neuron_id", "subject", "type", "x", "y", "z")
    if node_types is not None:
        rows = node_type_filter(rows, "include", node_types)
    if file_ids is not None:
        rows = keep_keys(rows, file_ids)
    if exclude_file_ids is not None:
        rows = keep_keys(rows, exclude_file_ids, keep=False)
    rows = rows.filter(all_finite("x", "y", "z"))
    return inside_voxels(rows, grid, mask).groupBy("file_id").agg(
        F.min("neuron_id").alias("neuron_id"), F.min("subject").alias("subject")
    ).orderBy("file_id")
