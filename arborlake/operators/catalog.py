"""Listings and summaries of the node table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import side_of
from ..functions.morton import in_ranges, ranges_of
from ..model import DENDRITE_TYPES, SOMA, Grid, all_finite
from ..session import keep_keys, lookup_join


def has_column(nodes: DataFrame, name: str) -> bool:
    return name in nodes.columns


def _narrow(nodes, soma_only=False, file_ids=None, exclude_file_ids=None, node_types=None) -> DataFrame:
    """Shared type, include and exclude filters; an explicit type list beats ``soma_only``."""
    if node_types is not None:
        nodes = nodes.filter(F.col("type").isin([int(t) for t in node_types]))
    elif soma_only:
        nodes = nodes.filter(F.col("type") == SOMA)
    if file_ids is not None:
        nodes = keep_keys(nodes, file_ids)
    if exclude_file_ids is not None:
        nodes = keep_keys(nodes, exclude_file_ids, keep=False)
    return nodes


def _neurons(nodes: DataFrame) -> DataFrame:
    return nodes.select("file_id", "neuron_id", "subject").distinct().orderBy("file_id", "neuron_id", "subject")


def neurons_by_region(nodes: DataFrame, acronyms: Iterable[str], **narrow) -> DataFrame:
    return _neurons(_narrow(nodes.filter(F.col("region_acronym").isin(list(acronyms))), **narrow))


def neurons_by_region_id(nodes: DataFrame, region_ids: Iterable[int], **narrow) -> DataFrame:
    return _neurons(_narrow(nodes.filter(F.col("region_id").isin([int(r) for r in region_ids])), **narrow))


def nodes_of(nodes: DataFrame, file_ids) -> DataFrame:
    return keep_keys(nodes, file_ids).orderBy("file_id", "node_id")


def soma_nodes(nodes: DataFrame, file_ids=None) -> DataFrame:
    somas = nodes.filter(F.col("type") == SOMA)
    return (somas if file_ids is None else keep_keys(somas, file_ids)).orderBy("file_id", "node_id")


def soma_points(nodes: DataFrame, file_ids=None) -> DataFrame:
    return soma_nodes(nodes, file_ids).select("file_id", "neuron_id", "x", "y", "z")


def unique_regions(nodes: DataFrame) -> DataFrame:
    return (
        nodes.filter(F.col("region_id") > 0).groupBy("region_id", "region_acronym")
        .agg(F.max("region_name").alias("region_name"), F.count(F.lit(1)).alias("node_count"))
        .orderBy(F.desc("node_count"), "region_id", "region_acronym")
    )


def region_neuron_counts(nodes: DataFrame) -> DataFrame:
    return (
        nodes.filter(F.col("region_acronym") != "").groupBy("region_acronym")
        .agg(F.max("region_name").alias("region_name"), F.count_distinct("file_id").alias("neuron_count"))
        .orderBy(F.desc("neuron_count"), "region_acronym")
    )


def _text_or_blank(nodes: DataFrame, name: str) -> Column:
    if name not in nodes.columns:
        return F.lit("")
    return F.coalesce(F.min(F.col(name).cast("string")), F.lit(""))


def neuron_catalog(nodes: DataFrame) -> DataFrame:
    """One row per file; display names are the smallest seen, blank when missing."""
    if "neuron_id" not in nodes.columns and "subject" not in nodes.columns:
        return nodes.select("file_id").distinct().withColumns({"neuron_id": F.lit(""), "subject": F.lit("")})
    return nodes.groupBy(F.col("file_id").cast("string").alias("file_id")).agg(
        _text_or_blank(nodes, "neuron_id").alias("neuron_id"), _text_or_blank(nodes, "subject").alias("subject")
    )


def soma_locations(nodes: DataFrame, file_ids=None) -> DataFrame:
    """An empty list means every file, as for ``None``."""
    somas = nodes.filter(F.col("type") == SOMA)
    if file_ids is not None and (isinstance(file_ids, DataFrame) or len(list(file_ids))):
        somas = keep_keys(somas, file_ids)
    return somas.groupBy("file_id", "neuron_id").agg(
        *[F.avg(c).alias(c) for c in "xyz"], F.max("region_acronym").alias("region_acronym")
    )


def soma_centroids(
    nodes: DataFrame, grid: Grid | None = None, region_voxels: DataFrame | None = None, excluded: DataFrame | None = None
) -> DataFrame:
    """Mean soma position per file with its row count; finite, inside the given voxels, not excluded."""
    rows = (
        nodes.filter(F.col("type") == SOMA).groupBy("file_id")
        .agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("soma_node_count"))
        .filter(all_finite("x", "y", "z"))
    )
    if region_voxels is not None:
        rows = inside_voxels(rows, grid, region_voxels)
    return rows if excluded is None else keep_keys(rows, excluded, keep=False)


def voxel_of(df: DataFrame, grid: Grid, name: str = "_voxel") -> DataFrame:
    """Add the linear voxel of (x, y, z); null for a row that is not finite or lies off the grid."""
    ai, bi, ci = grid.floor_index()
    index = F.when(all_finite("x", "y", "z") & grid.holds(ai, bi, ci), grid.linear(ai, bi, ci))
    return df.withColumn(name, index)


def voxel_keys(voxels: DataFrame, grid: Grid, name: str = "_voxel") -> DataFrame:
    return voxels.filter(grid.holds()).select(grid.linear().alias(name)).distinct()


def along_curve(df: DataFrame, voxels: DataFrame) -> DataFrame:
    """Rows near the voxels, where the table lies along a space-filling curve over their grid (``write_spatial_nodes``).

    At most 64 ranges of the curve hold all voxels; they are literals, so the scan skips the row groups of all others.
    """
    ranges = ranges_of(voxels) if "voxel_order" in df.columns else []
    return df.filter(in_ranges("voxel_order", ranges)) if ranges else df


def inside_voxels(df: DataFrame, grid: Grid, voxels: DataFrame, keep: bool = True) -> DataFrame:
    rows = voxel_of(along_curve(df, voxels.filter(grid.holds())) if keep else df, grid)
    return lookup_join(rows, voxel_keys(voxels, grid), "_voxel", "left_semi" if keep else "left_anti").drop("_voxel")


def statistics(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count(F.lit(1)).alias("node_count"), F.count_distinct("file_id").alias("file_count"),
        F.count_distinct("subject").alias("subject_count"),
        F.count_distinct(F.when(F.col("region_id") > 0, F.col("region_id"))).alias("region_count"),
    )


def parquet_summary(nodes: DataFrame) -> DataFrame:
    """Totals and the node count per acronym, as (section, key, value) rows."""
    totals = nodes.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("file_id").alias("files"),
        F.count_distinct("subject").alias("subjects"),
    ).select(F.expr("stack(3, 'rows', rows, 'files', files, 'subjects', subjects) AS (key, value)"))
    regions = nodes.filter(F.col("region_acronym") != "").groupBy(F.col("region_acronym").alias("key")).agg(
        F.count(F.lit(1)).alias("value")
    )
    return totals.select(F.lit("total").alias("section"), "key", "value").unionByName(
        regions.select(F.lit("region").alias("section"), "key", "value")
    )


def node_types_present(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type").isNotNull()).select("type").distinct().orderBy("type")


def dendrite_coverage(nodes: DataFrame, types: Iterable[int] = DENDRITE_TYPES) -> DataFrame:
    """Per file: does any node carry a dendrite label? Files without one are the excluded ones."""
    return nodes.groupBy("file_id").agg(
        F.coalesce(F.bool_or(F.col("type").isin(list(types))), F.lit(False)).alias("labelled")
    )


def soma_hemispheres(nodes: DataFrame, axis: str = "z", midline: float = 5695.0, tolerance: float = 1.0) -> DataFrame:
    somas = nodes.filter(F.col("type") == SOMA).select(
        "file_id", F.col(axis).alias("c"), side_of(axis, midline, tolerance).alias("side")
    )
    return somas.agg(
        F.count(F.lit(1)).alias("total_soma_nodes"), F.count_distinct("file_id").alias("neurons_with_soma"),
        *[F.count_if(F.col("side") == s).alias(f"{s}_count") for s in ("left", "midline", "right")],
        F.min("c").alias("coord_min"), F.avg("c").alias("coord_mean"), F.max("c").alias("coord_max"),
    )
