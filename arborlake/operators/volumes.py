"""Sparse voxel volumes: counts, masks, smoothing, thresholds and reductions. An absent row is zero."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quantiles import percentiles
from ..functions.ranks import number_rows
from ..model import Grid, all_finite, finite, pack_voxel, resolution3, unpack_voxel
from ..session import keep_keys, union_all
from .blocks import BlockVolume, at_voxels
from .catalog import inside_voxels, voxel_of
from .filters import VoxelNodeFilter, within_soma_radius
from .stencil import convolve

VOXEL = ("ai", "bi", "ci")


def scoped_nodes(
    nodes: DataFrame, grid: Grid | None = None, file_ids=None, include: DataFrame | None = None,
    exclude: DataFrame | None = None, node_filter: VoxelNodeFilter | None = None,
) -> DataFrame:
    """Rows that enter a voxel count: scope, region masks, node filter, finite coordinates."""
    whole = nodes if file_ids is None else keep_keys(nodes, file_ids)
    rows = whole
    if include is not None:
        rows = inside_voxels(rows, grid, include)
    if exclude is not None:
        rows = inside_voxels(rows, grid, exclude, keep=False)
    if node_filter is not None:
        rows = node_filter.apply(rows, whole)
    return rows.filter(all_finite("x", "y", "z"))


def voxel_counts(nodes: DataFrame, resolution: float | Sequence[float]) -> DataFrame:
    """(file_id, voxel, c): nodes per file and occupied voxel; combined before the shuffle."""
    index = [F.floor(F.col(c) / F.lit(r)) for c, r in zip("xyz", resolution3(resolution))]
    return (
        nodes.filter(all_finite("x", "y", "z"))
        .groupBy(F.col("file_id").cast("string").alias("file_id"), pack_voxel(*index).alias("voxel"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def with_indices(df: DataFrame) -> DataFrame:
    ai, bi, ci = unpack_voxel("voxel")
    return df.withColumns({"ai": ai, "bi": bi, "ci": ci}).drop("voxel")


def voxel_lut_join(nodes: DataFrame, grid: Grid, lut: DataFrame | BlockVolume) -> DataFrame:
    """Attach ``voxel_id`` of a lookup table (ai, bi, ci, voxel_id); rows without an id ≥ 0 vanish."""
    table = lut
    if isinstance(lut, DataFrame):
        table = lut.filter((F.col("voxel_id") >= 0) & grid.holds()).select(grid.linear().alias("_voxel"), "voxel_id")
    found = at_voxels(voxel_of(nodes, grid).filter("_voxel IS NOT NULL"), "_voxel", table, grid, ["voxel_id"])
    return found.filter("voxel_id >= 0").drop("_voxel")


def lut_counts(nodes: DataFrame, grid: Grid, lut: DataFrame) -> DataFrame:
    mapped = voxel_lut_join(nodes.select("file_id", "node_id", "x", "y", "z"), grid, lut)
    return mapped.groupBy("file_id", F.col("voxel_id").cast("long").alias("voxel")).agg(F.count(F.lit(1)).alias("c"))


def dense_voxel_ids(counts: DataFrame) -> DataFrame:
    """Occupied voxels numbered from 0 in axis order; only an export needs dense numbers."""
    return number_rows(counts.select("voxel").distinct(), ["voxel"], "voxel_id")


def heatmap_counts(
    nodes: DataFrame, grid: Grid, region_ids: Iterable[int] | None = None, file_ids=None, node_types=None,
    soma_radius_um: float | None = None, depth_bin_factor: int = 1, depth_axis: int = 0,
) -> DataFrame:
    """Nodes per voxel; one axis may be binned coarser. An empty region list is no filter."""
    rows, regions = nodes, list(region_ids or ())
    if regions:
        rows = rows.filter(F.col("region_id").isin([int(r) for r in regions]))
    if file_ids is not None:
        rows = keep_keys(rows, file_ids)
    if node_types is not None:
        rows = rows.filter(F.col("type").isin([int(v) for v in node_types]))
    if soma_radius_um is not None and soma_radius_um > 0:
        rows = within_soma_radius(rows, nodes, soma_radius_um)
    step, shape = list(grid.resolution), list(grid.shape)
    step[depth_axis] *= depth_bin_factor
    shape[depth_axis] = -(-shape[depth_axis] // depth_bin_factor)
    coarse = Grid(tuple(shape), tuple(step), grid.midline_um, grid.lr_axis)
    index = [i.alias(n) for i, n in zip(coarse.floor_index(), VOXEL)]
    return (
        rows.filter(all_finite("x", "y", "z")).groupBy(*index).agg(F.count(F.lit(1)).alias("n")).filter(coarse.holds())
    )


def search_heatmap(nodes: DataFrame, grid: Grid, file_ids=None, **scope) -> DataFrame:
    return heatmap_counts(scoped_nodes(nodes, grid, file_ids, **scope), grid)


def input_count(rows: DataFrame) -> DataFrame:
    """Contributing rows and files of a filtered plan."""
    return rows.agg(F.count(F.lit(1)).alias("node_count"), F.count_distinct("file_id").alias("file_count"))


# --- set algebra on masks

def mask_union(masks: Sequence[DataFrame]) -> DataFrame:
    return union_all([m.select(*VOXEL) for m in masks]).distinct()


def mask_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*VOXEL).intersect(b.select(*VOXEL))


def merge_heatmaps(volumes: Sequence[DataFrame], value: str = "n") -> DataFrame:
    return union_all([v.select(*VOXEL, value) for v in volumes]).groupBy(*VOXEL).agg(F.sum(value).alias(value))


def threshold_range(volume: DataFrame, value: str, lower: float, upper: float | None = None) -> DataFrame:
    if upper is not None and upper < lower:
        raise ValueError("upper threshold below the lower one")
    test = F.col(value) >= F.lit(float(lower))
    if upper is not None:
        test = test & (F.col(value) <= F.lit(float(upper)))
    return volume.filter(test).select(*VOXEL)


def isolate_regions(volume: DataFrame, annotation: DataFrame, region_ids: Iterable[int]) -> DataFrame:
    chosen = annotation.filter(F.col("region_id").isin([int(r) for r in region_ids])).select(*VOXEL).distinct()
    return volume.join(chosen, list(VOXEL), "left_semi")


# Fixed values of the anatomical planes: hidden, vertical and horizontal axis.
PLANE_AXES = {"coronal": (0, 1, 2), "horizontal": (1, 0, 2), "sagittal": (2, 1, 0)}


def reduce_volume(
    volume: DataFrame, grid: Grid, plane: str, value: str = "n", slab: bool = False, position: float | None = None,
    thickness: float | None = None, origin: Sequence[float] = (0.0, 0.0, 0.0),
) -> DataFrame:
    """Sum over the plane's hidden axis: all of it or a slab, which always holds the nearest layer."""
    hidden, vertical, horizontal = PLANE_AXES[plane]
    rows = volume
    if slab:
        step, size = grid.resolution[hidden], grid.shape[hidden]
        centres = origin[hidden] + np.arange(size) * step
        at = float(centres[size // 2]) if position is None or not math.isfinite(position) else float(position)
        width = thickness if thickness is not None and thickness > 0 else step
        chosen = np.flatnonzero(np.abs(centres - at) <= width / 2)
        if not chosen.size:
            chosen = np.array([np.argmin(np.abs(centres - at))])
        rows = rows.filter(F.col(VOXEL[hidden]).between(int(chosen.min()), int(chosen.max())))
    return rows.groupBy(F.col(VOXEL[vertical]).alias("row"), F.col(VOXEL[horizontal]).alias("column")).agg(
        F.sum(value).alias(value)
    )


# --- smoothing and thresholds

def gaussian_weights(sigma: float) -> list[float]:
    """Normalised kernel of radius int(4·sigma + 0.5)."""
    radius = int(4.0 * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * offsets**2 / sigma**2)
    return [float(w) for w in weights / weights.sum()]


def smooth_heatmap(volume: DataFrame, grid: Grid, sigma: float = 1.0, value: str = "n") -> DataFrame:
    """Separable Gaussian with nearest edges; sigma ≤ 0 copies. One exchange: blocks are convolved with the rims of their neighbours."""
    out = volume.select(*[F.col(v).cast("long").alias(v) for v in VOXEL], F.col(value).cast("double").alias(value))
    if sigma <= 0:
        return out
    return convolve(out, grid, VOXEL, value, gaussian_weights(sigma))


def _edges(low: float, high: float, bins: int) -> list[float]:
    step = (np.float64(high) - np.float64(low)) / bins
    edges = (np.arange(bins + 1) * step + low).astype(np.float32)
    edges[-1] = np.float32(high)
    return [float(e) for e in edges]


def _bin_of(value: Column, edges: list[float]) -> Column:
    """Bin by single-precision edges; the last bin holds its right edge. Null outside."""
    bins, low, high = len(edges) - 1, edges[0], edges[-1]
    table = F.array(*[F.lit(e) for e in edges])
    guess = F.least(F.floor((value - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
    down = F.when(value < F.element_at(table, guess + 1), 1).otherwise(0)
    up = F.when((guess < bins - 1) & (value >= F.element_at(table, guess + 2)), 1).otherwise(0)
    return F.when(value.between(F.lit(low), F.lit(high)), guess - down + up)


def _single(value: str) -> Column:
    """The value as stored in a single-precision volume."""
    return F.col(value).cast("float").cast("double")


def histogram_shared(volumes: DataFrame, value: str = "n", bins: int = 256, include_zero: bool = False) -> DataFrame:
    """(name, bin, lower, upper, count) over common edges; empty bins are absent."""
    if bins <= 0:
        raise ValueError("bins must be positive")
    rows = volumes.select("name", _single(value).alias("v")).filter(finite("v"))
    if not include_zero:
        rows = rows.filter("v <> 0")
    bounds = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    low, high = (0.0, 1.0) if bounds["lo"] is None else (bounds["lo"], bounds["hi"])
    if bounds["lo"] is not None and np.isclose(low, high):
        width = max(abs(low) * 0.01, 0.5)
        low, high = low - width, high + width
    edges = _edges(low, high, bins)
    table = F.array(*[F.lit(e) for e in edges])
    counted = rows.groupBy("name", _bin_of(F.col("v"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.filter("bin IS NOT NULL").select(
        "name", "bin", F.element_at(table, F.col("bin") + 1).alias("lower"),
        F.element_at(table, F.col("bin") + 2).alias("upper"), "count",
    )


def otsu_threshold(volume: DataFrame, value: str = "n", bins: int = 256) -> DataFrame:
    """One row: threshold over the positive voxels.

    The upper class mean divides the sum from a bin on by the count beyond it, as the tool to be matched does.
    At most 256 histogram rows pass through the windows.
    """
    positive = volume.select(_single(value).alias("v")).filter(finite("v") & (F.col("v") > 0))
    found = positive.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spark = volume.sparkSession
    if not found["n"] or found["hi"] <= found["lo"]:
        return spark.createDataFrame([(float(found["lo"] or 0.0),)], "threshold double")
    edges = _edges(found["lo"], found["hi"], min(bins, found["n"]))
    centres = [float(np.float32((np.float32(a) + np.float32(b)) * np.float32(0.5))) for a, b in zip(edges, edges[1:])]
    hist = positive.groupBy(_bin_of(F.col("v"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("h"))
    frame = spark.createDataFrame(list(enumerate(centres)), "bin int, centre double")
    table = frame.join(hist, "bin", "left").select("bin", "centre", F.coalesce("h", F.lit(0)).cast("double").alias("h"))
    order = Window.orderBy("bin")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    table = table.withColumns({
        "w1": F.sum("h").over(upto), "s1": F.sum(F.col("h") * F.col("centre")).over(upto),
        "w2": F.sum("h").over(onward) - F.col("h"), "s2": F.sum(F.col("h") * F.col("centre")).over(onward),
    }).withColumns({
        "m1": F.when(F.col("w1") > 0, F.try_divide("s1", "w1")).otherwise(0.0),
        "m2": F.when(F.col("w2") > 0, F.try_divide("s2", "w2")).otherwise(0.0),
    }).withColumns({"w2n": F.lead("w2").over(order), "m2n": F.lead("m2").over(order)})
    scored = table.filter("w2n IS NOT NULL").withColumn(
        "between", F.col("w1") * F.col("w2n") * F.pow(F.col("m1") - F.col("m2n"), F.lit(2.0))
    )
    best = F.max_by("centre", F.struct("between", -F.col("bin")))
    return scored.agg(F.coalesce(best, F.lit(float(found["lo"]))).alias("threshold"))


def heatmap_to_mask(volume: DataFrame, grid: Grid, sigma: float = 1.0, threshold: float | None = None, value: str = "n"):
    """Smoothed volume and its mask; without a manual threshold Otsu's is used."""
    smooth = smooth_heatmap(volume, grid, sigma, value)
    limit = F.lit(float(threshold)) if threshold is not None else otsu_threshold(smooth, value).scalar()
    rows = smooth if threshold is not None else smooth.filter(F.col(value) > 0)
    return smooth, rows.filter(_single(value) >= limit).select(*VOXEL)


def matrix_contrast(pairs: DataFrame, value: str = "distance", diagonal: Sequence[float] = ()) -> dict:
    """Range and 1st/99th percentiles of the finite off-diagonal pairs (each pair once)."""
    rows = pairs.filter(finite(value)).select(F.col(value).alias("v"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    own = [d for d in diagonal if math.isfinite(d)]
    if not found["n"]:
        low, high = (min(own), max(own)) if own else (0.0, 1.0)
        return {"minimum": low, "maximum": high, "lower": low, "upper": high, "fallback": False,
                "message": "No finite off-diagonal distances to stretch."}
    low, high = float(found["lo"]), float(found["hi"])
    lower, upper = percentiles(rows, "v", [1, 99], found["n"])
    fallback = lower == upper
    if fallback:
        lower, upper = low, high
    message = f"All finite off-diagonal distances equal {low:.10g}; no contrast to stretch." if low == high else ""
    return {"minimum": min([low, *own]), "maximum": max([high, *own]), "lower": lower, "upper": upper,
            "fallback": fallback, "message": message}
