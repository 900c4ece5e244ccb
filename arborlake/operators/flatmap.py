"""Cortical flatmap: projection of nodes, bins, heatmaps, layers and soma coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clamp
from ..model import CORTICAL_LAYERS, INVALID_CODES, SOMA, Grid, all_finite, col, finite
from ..session import keep_keys, lookup_join
from .blocks import at_voxels
from .pearson import PearsonResult, pearson
from .volumes import scoped_nodes

MIRROR_MIDLINE_UM = 5687.5


def nondegenerate(low: float, high: float) -> tuple[float, float]:
    if not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError("bounds must be finite")
    if high > low:
        return float(low), float(high)
    pad = max(abs(low) * 0.01, 0.5)
    return float(low - pad), float(high + pad)


@dataclass(frozen=True)
class FlatGrid:
    """Bin grid of one flatmap style; ``x_bins=None`` gives square bins."""

    style: str
    x_bounds: tuple[float, float]
    y_bounds: tuple[float, float]
    depth_bounds: tuple[float, float] = (0.0, 1.0)
    y_bins: int = 256
    x_bins: int | None = None
    depth_bin_um: float = 25.0
    depth_minus_one: bool = True
    collapse_depth: bool = False

    def __post_init__(self):
        for name in ("x_bounds", "y_bounds", "depth_bounds"):
            object.__setattr__(self, name, nondegenerate(*getattr(self, name)))
        if self.y_bins < 1 or not self.depth_bin_um > 0:
            raise ValueError("bins must be positive")
        if self.x_bins is None:
            aspect = (self.x_bounds[1] - self.x_bounds[0]) / (self.y_bounds[1] - self.y_bounds[0])
            object.__setattr__(self, "x_bins", max(1, math.floor(self.y_bins * aspect + 0.5)))
        if self.x_bins < 1:
            raise ValueError("bins must be positive")

    @property
    def offset(self) -> int:
        return 1 if self.depth_minus_one else 0

    @property
    def valid_depth_bins(self) -> int:
        low, high = self.depth_bounds
        return max(1, math.floor((high - low) / self.depth_bin_um) + 1)

    @property
    def planes(self) -> int:
        return 1 if self.collapse_depth else self.valid_depth_bins + self.offset

    @property
    def plane_size(self) -> int:
        return self.y_bins * self.x_bins

    @property
    def cells(self) -> int:
        return self.planes * self.plane_size

    def columns(self) -> tuple[str, str]:
        return (f"x_flat_{self.style}", f"y_flat_{self.style}") if self.style else ("x_flat", "y_flat")


def _valid_name(style: str) -> str:
    return f"flatmap_{style}_valid" if style else "flatmap_valid"


def flatmap_valid(df: DataFrame, style: str) -> Column:
    """The stored flag if present, otherwise finite coordinates."""
    if _valid_name(style) in df.columns:
        return F.coalesce(F.col(_valid_name(style)), F.lit(False))
    x, y = (f"x_flat_{style}", f"y_flat_{style}") if style else ("x_flat", "y_flat")
    return all_finite(x, y)


def depth_valid(df: DataFrame) -> Column:
    if "depth_valid" in df.columns:
        return F.coalesce(F.col("depth_valid"), F.lit(False))
    return finite("depth_um") & (F.col("depth_um") >= 0)


def depth_minus_one() -> Column:
    return F.coalesce(finite("depth_um") & (F.col("depth_um") == -1.0), F.lit(False))


def rendered(df: DataFrame, grid: FlatGrid) -> Column:
    depth = depth_valid(df)
    return flatmap_valid(df, grid.style) & ((depth | depth_minus_one()) if grid.depth_minus_one else depth)


def _axis_bin(value: Column | str, bounds: tuple[float, float], bins: int) -> Column:
    """Clamped bin in double arithmetic, (v - lo) / span * bins; 0 for a value that is not finite."""
    v = col(value).cast("double")
    low, high = bounds
    scaled = F.floor((v - F.lit(low)) / F.lit(high - low) * bins)
    return F.when(finite(v), clamp(scaled, 0, bins - 1)).otherwise(F.lit(0).cast("long"))


def _depth_bin(df: DataFrame, grid: FlatGrid) -> Column:
    v = F.col("depth_um").cast("double")
    raw = F.floor((v - F.lit(grid.depth_bounds[0])) / F.lit(grid.depth_bin_um))
    inner = F.when(finite(v), clamp(raw, 0, grid.valid_depth_bins - 1)).otherwise(F.lit(0).cast("long"))
    return F.when(depth_valid(df), inner + grid.offset).otherwise(F.lit(0).cast("long"))


def flatmap_bins(df: DataFrame, grid: FlatGrid) -> DataFrame:
    """Rendered rows with y_bin, x_bin and, unless collapsed, depth_bin."""
    x, y = grid.columns()
    bins = {"y_bin": _axis_bin(y, grid.y_bounds, grid.y_bins), "x_bin": _axis_bin(x, grid.x_bounds, grid.x_bins)}
    if not grid.collapse_depth:
        bins["depth_bin"] = _depth_bin(df, grid)
    return df.filter(rendered(df, grid)).withColumns(bins)


def bin_names(grid: FlatGrid) -> list[str]:
    return ["y_bin", "x_bin"] if grid.collapse_depth else ["depth_bin", "y_bin", "x_bin"]


def linear_bin(grid: FlatGrid) -> Column:
    plane = F.col("y_bin") * grid.x_bins + F.col("x_bin")
    return plane if grid.collapse_depth else F.col("depth_bin") * grid.plane_size + plane


def flat_counts(
    df: DataFrame, grid: FlatGrid, node_filter=None, voxels: Grid | None = None, file_ids=None,
    include: DataFrame | None = None, exclude: DataFrame | None = None,
) -> DataFrame:
    """(file_id, voxel, c) on the flatmap grid, of the chosen files and of nodes inside and outside the masks of ``voxels``."""
    if include is not None or exclude is not None:
        rows = scoped_nodes(df, voxels, file_ids, include, exclude, node_filter)
    else:
        rows = df if file_ids is None else keep_keys(df, file_ids)
        rows = rows if node_filter is None else node_filter.apply(rows, rows)
    return flatmap_bins(rows, grid).groupBy(F.col("file_id").cast("string").alias("file_id"), linear_bin(grid).alias("voxel")).agg(
        F.count(F.lit(1)).alias("c")
    )


def flatmap_pearson(
    df: DataFrame, grid: FlatGrid, node_filter=None, voxels: Grid | None = None, file_ids=None,
    include: DataFrame | None = None, exclude: DataFrame | None = None,
) -> PearsonResult:
    return pearson(flat_counts(df, grid, node_filter, voxels, file_ids, include, exclude), "flatmap")


def flatmap_stats(df: DataFrame, grid: FlatGrid) -> DataFrame:
    """Node and trace tallies in one pass."""
    valid, shown = flatmap_valid(df, grid.style), rendered(df, grid)
    return df.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_distinct("file_id").alias("total_traces"),
        F.count_if(valid).alias("flatmap_valid_nodes"), F.count_if(valid & depth_valid(df)).alias("depth_valid_nodes"),
        F.count_if(valid & depth_minus_one()).alias("depth_minus_one_nodes"), F.count_if(shown).alias("rendered_nodes"),
        F.count_distinct(F.when(shown, F.col("file_id"))).alias("traces_represented"),
    )


def _grouped(binned: DataFrame, keys: Sequence[str], by: str, clusters: DataFrame | None) -> DataFrame:
    if by == "single":
        return binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("node_count"))
    per_file = binned.groupBy("file_id", *keys).agg(F.count(F.lit(1)).alias("node_count"))
    if by == "file":
        return per_file
    if by != "cluster" or clusters is None:
        raise ValueError("grouping is single, file or cluster with a label table")
    labels = clusters.select("file_id", F.col("label").alias("cluster"))
    joined = lookup_join(per_file, labels, "file_id", "left", salt_by=list(keys))
    return joined.groupBy("cluster", *keys).agg(F.sum("node_count").alias("node_count"))


def flatmap_heatmap(df: DataFrame, grid: FlatGrid, by: str = "single", clusters: DataFrame | None = None) -> DataFrame:
    """Node counts per bin: one volume, one per file, or one per cluster (null cluster = unclustered, last)."""
    out = _grouped(flatmap_bins(df, grid), bin_names(grid), by, clusters)
    return out.orderBy(F.asc_nulls_last("cluster"), *bin_names(grid)) if by == "cluster" else out


def plane_labels(grid: FlatGrid, spark) -> DataFrame:
    """A text per depth plane of the grid; the first is the depth −1 plane when it is included."""
    rows = [(0, "depth -1")] if grid.depth_minus_one else []
    for plane in range(grid.valid_depth_bins):
        low = grid.depth_bounds[0] + plane * grid.depth_bin_um
        rows.append((plane + grid.offset, f"{low:g}-{low + grid.depth_bin_um:g} um"))
    return spark.createDataFrame(rows, "depth_bin int, label string")


def plane_points(df: DataFrame, grid: FlatGrid) -> DataFrame:
    """Rendered rows as points on their bins."""
    return flatmap_bins(df, grid).select("file_id", *bin_names(grid))


# --- bounds

def lookup_valid(zero_sentinel: bool = False, negative_one_sentinel: bool = True, x="x_flat", y="y_flat") -> Column:
    ok = all_finite(x, y)
    if negative_one_sentinel:
        ok = ok & ~((col(x) == -1.0) & (col(y) == -1.0))
    if zero_sentinel:
        ok = ok & ~((col(x) == 0.0) & (col(y) == 0.0))
    return ok


def lookup_stats(lookup: DataFrame, zero_sentinel: bool = False, negative_one_sentinel: bool = True) -> DataFrame:
    """Bounds and valid-voxel counts of a lookup volume, one row."""
    ok = lookup_valid(zero_sentinel, negative_one_sentinel)
    deep = finite("depth_um") & (F.col("depth_um") >= 0)
    when = lambda test, c: F.when(test, F.col(c))
    return lookup.agg(
        F.min(when(ok, "x_flat")).alias("x_min"), F.max(when(ok, "x_flat")).alias("x_max"),
        F.min(when(ok, "y_flat")).alias("y_min"), F.max(when(ok, "y_flat")).alias("y_max"),
        F.min(when(deep, "depth_um")).alias("depth_min"), F.max(when(deep, "depth_um")).alias("depth_max"),
        F.count_if(ok).alias("flatmap_valid_voxels"), F.count_if(deep).alias("depth_valid_voxels"),
    )


def observed_bounds(df: DataFrame, style: str) -> DataFrame:
    """Finite ranges of the valid rows; depth counts from 0 upward."""
    x, y = (f"x_flat_{style}", f"y_flat_{style}") if style else ("x_flat", "y_flat")
    ok = flatmap_valid(df, style) & all_finite(x, y)
    deep = flatmap_valid(df, style) & depth_valid(df) & finite("depth_um") & (F.col("depth_um") >= 0)
    span = lambda test, c, name: [f(F.when(test, F.col(c).cast("double"))).alias(f"{name}_{n}") for f, n in ((F.min, "min"), (F.max, "max"))]
    return df.agg(*span(ok, x, "x"), *span(ok, y, "y"), *span(deep, "depth_um", "depth"))


def grid_bounds(df: DataFrame, style: str, canonical: dict | None = None) -> dict:
    """Bounds from the stored grid description, otherwise from the data; ``source`` tells which."""
    if canonical is not None:
        return {**{k: tuple(canonical[k]) for k in ("x_bounds", "y_bounds", "depth_bounds")}, "source": "canonical"}
    row = observed_bounds(df, style).first()
    if row["x_min"] is None or row["y_min"] is None:
        raise ValueError("no valid flatmap coordinates")
    if row["depth_min"] is None:
        raise ValueError("no valid non-negative depths")
    pair = lambda n: nondegenerate(row[f"{n}_min"], row[f"{n}_max"])
    return {"x_bounds": pair("x"), "y_bounds": pair("y"), "depth_bounds": pair("depth"), "source": "observed"}


def grid_for(df: DataFrame, style: str, canonical: dict | None = None, **bins) -> FlatGrid:
    bounds = grid_bounds(df, style, canonical)
    return FlatGrid(style, bounds["x_bounds"], bounds["y_bounds"], bounds["depth_bounds"], **bins)


# --- projection

@dataclass(frozen=True)
class Projection:
    """How node coordinates become lookup voxels: micrometres, voxels or an affine inverse."""

    grid: Grid
    in_voxels: bool = False
    origin: tuple[float, float, float] | None = None
    inverse: tuple[tuple[float, float, float], ...] | None = None
    zero_sentinel: bool = False
    negative_one_sentinel: bool = True
    mirror_axis: int = 2
    mirror_midline: float | None = None

    @property
    def midline(self) -> float:
        if self.mirror_midline is not None:
            return self.mirror_midline
        return (self.grid.shape[self.mirror_axis] - 1) / 2 if self.in_voxels else MIRROR_MIDLINE_UM

    def voxels(self, mirrored: bool = False) -> list[Column]:
        """Nearest voxel: floor(v + 0.5)."""
        xyz = [F.col(c) for c in "xyz"]
        if mirrored:
            xyz[self.mirror_axis] = F.lit(2.0 * self.midline) - xyz[self.mirror_axis]
        if self.in_voxels:
            values = xyz
        elif self.inverse is not None and self.origin is not None:
            moved = [c - F.lit(float(o)) for c, o in zip(xyz, self.origin)]
            values = [
                sum((moved[i] * F.lit(float(self.inverse[i][j])) for i in range(1, 3)), moved[0] * F.lit(float(self.inverse[0][j])))
                for j in range(3)
            ]
        else:
            values = [c / F.lit(r) for c, r in zip(xyz, self.grid.resolution)]
        return [F.floor(v + F.lit(0.5)) for v in values]


def _keyed(df: DataFrame, p: Projection, prefix: str, mirrored: bool = False, only: Column | None = None) -> DataFrame:
    """Add voxel indices, the in-bounds flag and the linear key (null out of bounds or when not wanted)."""
    test = all_finite("x", "y", "z") if only is None else all_finite("x", "y", "z") & only
    names = [f"{prefix}{n}" for n in ("i", "j", "k")]
    out = df.withColumns({n: F.when(test, v) for n, v in zip(names, p.voxels(mirrored))})
    inside = F.coalesce(p.grid.holds(*names), F.lit(False))
    return out.withColumns({f"{prefix}in": inside, f"{prefix}key": F.when(inside, p.grid.linear(*names))})


def _lookup_table(lookup: DataFrame, grid: Grid, key: str, prefix: str) -> DataFrame:
    return lookup.filter(grid.holds()).select(
        grid.linear().alias(key), *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in ("x_flat", "y_flat", "depth_um")]
    )


def project_nodes(nodes: DataFrame, lookup: DataFrame, p: Projection, mirror_fallback: bool = False) -> DataFrame:
    """Nodes with x_flat, y_flat, depth_um, validity, reason and lookup mode.

    With the fallback, rows that fail look up the mirrored coordinate: a valid map position keeps its own voxel
    and may take the mirrored depth; otherwise the whole mirrored projection is taken if it is valid.
    """
    kept = [c for c in nodes.columns if c not in ("x_flat", "y_flat", "depth_um", "flatmap_valid", "depth_valid", "valid")]
    ident = ["file_id", "node_id"]
    table = _lookup_table(lookup, p.grid, "d_key", "d_")
    rows = at_voxels(_keyed(nodes.select(*kept), p, "d_"), "d_key", table, p.grid, table.columns[1:], salt_by=ident)
    good = lambda s: F.coalesce(F.col(f"{s}in") & lookup_valid(p.zero_sentinel, p.negative_one_sentinel, f"{s}x_flat", f"{s}y_flat"), F.lit(False))
    deep = lambda s: F.coalesce(F.col(f"{s}in") & finite(f"{s}depth_um") & (F.col(f"{s}depth_um") >= 0), F.lit(False))
    rows = rows.withColumns({"d_map": good("d_"), "d_deep": deep("d_")}).withColumn("d_ok", F.col("d_map") & F.col("d_deep"))
    if mirror_fallback:
        rows = _keyed(rows, p, "m_", mirrored=True, only=~F.col("d_ok"))
        table = _lookup_table(lookup, p.grid, "m_key", "m_")
        rows = at_voxels(rows, "m_key", table, p.grid, table.columns[1:], salt_by=ident, summary=_keyed(nodes, p, "m_", mirrored=True))
        rows = rows.withColumns({"m_map": good("m_"), "m_deep": deep("m_")}).withColumns({
            "take_depth": F.col("d_map") & ~F.col("d_deep") & F.col("m_deep"),
            "take_all": ~F.col("d_map") & F.col("m_map") & F.col("m_deep"),
        })
    else:
        rows = rows.withColumns({"take_depth": F.lit(False), "take_all": F.lit(False)})
    m = lambda name: F.col(f"m_{name}") if mirror_fallback else F.col(f"d_{name}")
    all_or = lambda name: F.when(F.col("take_all"), m(name)).otherwise(F.col(f"d_{name}"))
    reason = (
        F.when(F.col("d_ok") | F.col("take_depth") | F.col("take_all"), "").when(~all_finite("x", "y", "z"), "missing_input")
        .when(~F.col("d_in"), "out_of_bounds").when(~F.col("d_map"), "invalid_flatmap").otherwise("invalid_depth")
    )
    mode = (
        F.when(F.col("d_ok"), "direct").when(F.col("take_depth"), "mirrored_depth").when(F.col("take_all"), "mirrored")
        .otherwise("unmapped")
    )
    return rows.select(
        *kept, all_or("i").alias("voxel_i"), all_or("j").alias("voxel_j"), all_or("k").alias("voxel_k"),
        all_or("x_flat").alias("x_flat"), all_or("y_flat").alias("y_flat"),
        F.when(F.col("take_depth") | F.col("take_all"), m("depth_um")).otherwise(F.col("d_depth_um")).alias("depth_um"),
        (F.col("d_map") | F.col("take_all")).alias("flatmap_valid"),
        (F.col("d_deep") | F.col("take_depth") | F.col("take_all")).alias("depth_valid"),
        (F.col("d_ok") | F.col("take_depth") | F.col("take_all")).alias("valid"),
        reason.alias("invalid_reason"), mode.alias("flatmap_lookup_mode"),
    )


def _code(reason: Column) -> Column:
    out = F.lit(0)
    for text, code in INVALID_CODES.items():
        out = F.when(reason == text, code).otherwise(out)
    return out.cast("byte")


def augment_v2(nodes: DataFrame, lookup: DataFrame, p: Projection, mirror_fallback: bool = True) -> DataFrame:
    """Stored single-style columns: single precision, flags, code and lookup mode."""
    done = project_nodes(nodes, lookup, p, mirror_fallback)
    kept = [c for c in nodes.columns if c in done.columns]
    kept = [c for c in kept if c not in ("x_flat", "y_flat", "depth_um", "flatmap_valid", "depth_valid", "valid")]
    return done.select(
        *kept, *[F.col(c).cast("float").alias(c) for c in ("x_flat", "y_flat", "depth_um")], "flatmap_valid", "depth_valid",
        F.col("valid").alias("flatmap_projection_valid"), _code(F.col("invalid_reason")).alias("flatmap_invalid_code"),
        "flatmap_lookup_mode",
    )


def augment_v3(
    nodes: DataFrame, shaped: DataFrame, square: DataFrame, depth: DataFrame, p: Projection
) -> DataFrame:
    """Both map styles and the shared depth. XY comes from the node's own voxel only.

    The depth of the mirrored voxel ``n-1-k`` belongs to the lookup volume, so it is attached there and the nodes
    are joined once.
    """
    grid, axis = p.grid, p.mirror_axis
    key = grid.linear().alias("key")
    index = [F.col(n) for n in ("ai", "bi", "ci")]
    index[axis] = F.lit(grid.shape[axis] - 1) - index[axis]
    single = lambda c: F.col(c).cast("float").cast("double")
    deep = depth.filter(grid.holds()).select(key, single("depth_um").alias("d0"))
    other = depth.filter(grid.holds()).select(grid.linear(*index).alias("key"), single("depth_um").alias("d1"))
    xy = lambda v, s: v.filter(grid.holds()).select(key, single("x_flat").alias(f"x_{s}"), single("y_flat").alias(f"y_{s}"))
    table = xy(shaped, "shaped").join(xy(square, "square"), "key", "full").join(deep, "key", "full").join(other, "key", "full")
    replaced = {"depth_um", "depth_valid", "depth_invalid_code", "depth_lookup_mode"} | {
        n for s in ("shaped", "square")
        for n in (f"x_flat_{s}", f"y_flat_{s}", f"flatmap_{s}_valid", f"flatmap_{s}_projection_valid",
                  f"flatmap_{s}_invalid_code", f"flatmap_{s}_lookup_mode")
    }
    kept = [c for c in nodes.columns if c not in replaced]
    rows = _keyed(nodes.select(*kept), p, "v_").withColumnRenamed("v_key", "key")
    rows = at_voxels(rows, "key", table, p.grid, table.columns[1:], salt_by=["file_id", "node_id"])
    usable = lambda c: F.coalesce(F.col("v_in") & finite(c) & (F.col(c) >= 0), F.lit(False))
    rows = rows.withColumns({"own": usable("d0"), "back": ~usable("d0") & usable("d1")})
    rows = rows.withColumn("deep", F.col("own") | F.col("back"))
    nan = F.lit(float("nan"))
    base = F.when(~all_finite("x", "y", "z"), 1).when(~F.col("v_in"), 2)
    out: list[Column] = [F.col(c) for c in kept]
    for s in ("shaped", "square"):
        ok = F.coalesce(F.col("v_in") & lookup_valid(p.zero_sentinel, p.negative_one_sentinel, f"x_{s}", f"y_{s}"), F.lit(False))
        out += [
            F.when(ok, F.col(f"x_{s}")).otherwise(nan).cast("float").alias(f"x_flat_{s}"),
            F.when(ok, F.col(f"y_{s}")).otherwise(nan).cast("float").alias(f"y_flat_{s}"),
            ok.alias(f"flatmap_{s}_valid"), (ok & F.col("deep")).alias(f"flatmap_{s}_projection_valid"),
            base.when(~ok, 3).when(~F.col("deep"), 4).otherwise(0).cast("byte").alias(f"flatmap_{s}_invalid_code"),
            F.when(ok, "direct").otherwise("unmapped").alias(f"flatmap_{s}_lookup_mode"),
        ]
    depth_value = F.when(F.col("own"), F.col("d0")).when(F.col("back"), F.col("d1")).otherwise(nan)
    out += [
        depth_value.cast("float").alias("depth_um"), F.col("deep").alias("depth_valid"),
        base.when(~F.col("deep"), 4).otherwise(0).cast("byte").alias("depth_invalid_code"),
        F.when(F.col("own"), "direct").when(F.col("back"), "mirrored_depth").otherwise("unmapped").alias("depth_lookup_mode"),
    ]
    return rows.select(*out)


def projected_segments(projected: DataFrame, flag: str = "valid") -> DataFrame:
    """Parent → child segments whose two ends carry the flag."""
    ok = projected.filter(F.coalesce(F.col(flag), F.lit(False)))
    child = ok.select("file_id", "node_id", "parent_id", F.col("x_flat").alias("x2"), F.col("y_flat").alias("y2"))
    parent = ok.select("file_id", F.col("node_id").alias("parent_id"), F.col("x_flat").alias("x1"), F.col("y_flat").alias("y1"))
    return child.join(parent, ["file_id", "parent_id"]).select("file_id", "parent_id", "node_id", "x1", "y1", "x2", "y2")


def projection_summary(projected: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """One row of counts. Traces are folded per file first, so one large file is summed in parallel."""
    reason, mode = F.col("invalid_reason"), F.col("flatmap_lookup_mode")
    tally = {
        "total_nodes": F.count(F.lit(1)), "valid_nodes": F.count_if("valid"),
        **{f"{r}_nodes": F.count_if(reason == r) for r in INVALID_CODES if r},
        **{f"{k}_lookup_nodes": F.count_if(mode == k) for k in ("direct", "mirrored_depth", "mirrored", "unmapped")},
    }
    files = projected.groupBy("file_id").agg(*[v.alias(k) for k, v in tally.items()])
    partial = (F.col("valid_nodes") > 0) & (F.col("valid_nodes") < F.col("total_nodes"))
    out = files.agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in tally], F.count(F.lit(1)).alias("total_traces"),
        F.count_if(partial).alias("traces_with_partial_projection"),
    )
    return out if segments is None else out.withColumn("rendered_segments", segments.agg(F.count(F.lit(1))).scalar())


def segment_pixels(segments: DataFrame, grid: FlatGrid) -> DataFrame:
    """Segment start and direction in image pixels, for any number of segments."""
    def pixel(name, bounds, bins):
        scaled = (F.col(name).cast("double") - F.lit(bounds[0])) / F.lit(bounds[1] - bounds[0]) * bins - F.lit(0.5)
        return F.least(F.greatest(scaled, F.lit(-0.5)), F.lit(bins - 0.5))
    r1, r2 = (pixel(n, grid.y_bounds, grid.y_bins) for n in ("y1", "y2"))
    c1, c2 = (pixel(n, grid.x_bounds, grid.x_bins) for n in ("x1", "x2"))
    return segments.select(
        "file_id", "parent_id", "node_id", r1.cast("float").alias("row"), c1.cast("float").alias("column"),
        (r2 - r1).cast("float").alias("d_row"), (c2 - c1).cast("float").alias("d_column"),
    )


# --- cortical layers

def _with_layer(df: DataFrame, layers: DataFrame) -> DataFrame:
    table = layers.select("region_id", "layer_index")
    return lookup_join(df, table, "region_id", "left", salt_by=["file_id", "node_id"])


def _layer_valid(df: DataFrame, grid: FlatGrid) -> Column:
    x, y = grid.columns()
    return flatmap_valid(df, grid.style) & all_finite(x, y)


def _selected(selected: Sequence[int] | None) -> list[int]:
    chosen = list(range(len(CORTICAL_LAYERS))) if selected is None else [int(i) for i in selected]
    if not chosen or len(set(chosen)) != len(chosen) or any(not 0 <= i < len(CORTICAL_LAYERS) for i in chosen):
        raise ValueError("select one or more different layers")
    return chosen


def layer_heatmap(
    df: DataFrame, layers: DataFrame, grid: FlatGrid, selected: Sequence[int] | None = None, stack: bool = True,
    by: str = "single", clusters: DataFrame | None = None,
) -> DataFrame:
    """XY counts per chosen layer plane, or summed over the layers; the numeric depth is ignored."""
    chosen = _selected(selected)
    x, y = grid.columns()
    rows = _with_layer(df, layers)
    plane = F.array_position(F.array(*[F.lit(i) for i in chosen]), F.col("layer_index")) - 1
    binned = rows.filter(_layer_valid(rows, grid) & F.col("layer_index").isin(chosen)).withColumns({
        "plane": plane.cast("int"), "y_bin": _axis_bin(y, grid.y_bounds, grid.y_bins),
        "x_bin": _axis_bin(x, grid.x_bounds, grid.x_bins),
    })
    return _grouped(binned, ["plane", "y_bin", "x_bin"] if stack else ["y_bin", "x_bin"], by, clusters)


def layer_stats(df: DataFrame, layers: DataFrame, grid: FlatGrid, selected: Sequence[int] | None = None) -> DataFrame:
    chosen = _selected(selected)
    rows = _with_layer(df, layers)
    valid, classified = _layer_valid(rows, grid), F.col("layer_index").isNotNull()
    shown = valid & F.coalesce(F.col("layer_index").isin(chosen), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_distinct("file_id").alias("total_traces"),
        F.count_if(valid).alias("flatmap_valid_nodes"), F.count_if(classified).alias("layer_classified_nodes"),
        F.count_if(shown).alias("rendered_nodes"), F.count_distinct(F.when(shown, F.col("file_id"))).alias("traces_represented"),
        F.count_if(valid & classified & ~shown).alias("excluded_unselected_layer_nodes"),
    )


# --- somas

def flatmap_soma_coords(nodes: DataFrame, style: str, file_ids=None, excluded: DataFrame | None = None) -> DataFrame:
    """Mean map position, depth and CCF position of each file's projected somas."""
    somas = nodes.filter(F.col("type") == SOMA)
    if file_ids is not None:
        somas = keep_keys(somas, file_ids)
    ok = flatmap_valid(nodes, style) & depth_valid(nodes)
    x, y = (f"x_flat_{style}", f"y_flat_{style}") if style else ("x_flat", "y_flat")
    mean = lambda c: F.avg(F.when(ok, F.col(c).cast("double")))
    out = somas.groupBy("file_id").agg(
        mean(x).alias("x_flat"), mean(y).alias("y_flat"), mean("depth_um").alias("depth_um"),
        *[F.avg(c).alias(c) for c in "xyz"], F.count_if(ok).alias("soma_node_count"),
    ).filter((F.col("soma_node_count") > 0) & all_finite("x_flat", "y_flat", "depth_um"))
    return out if excluded is None else keep_keys(out, excluded, keep=False)


def normalize_soma(coords: DataFrame, bounds: dict, depth_scale: float = 1.0, include_depth: bool = True) -> DataFrame:
    """Both map axes divided by the y span, depth by its own span times a weight."""
    if depth_scale < 0:
        raise ValueError("depth_scale must not be negative")
    span_y = bounds["y_bounds"][1] - bounds["y_bounds"][0]
    span_d = bounds["depth_bounds"][1] - bounds["depth_bounds"][0]
    if not span_y > 0 or not span_d > 0:
        raise ValueError("spans must be positive")
    out = [(F.col("x_flat") / F.lit(span_y)).alias("x"), (F.col("y_flat") / F.lit(span_y)).alias("y")]
    if include_depth:
        out.append(((F.col("depth_um") / F.lit(span_d)) * F.lit(float(depth_scale))).alias("z"))
    return coords.select("file_id", *out, F.lit(bounds.get("source", "canonical")).alias("bounds_source"))


def flatmap_input_count(df: DataFrame, grid: FlatGrid, node_filter=None) -> DataFrame:
    rows = df if node_filter is None else node_filter.apply(df, df)
    shown = rows.filter(rendered(rows, grid))
    return shown.agg(F.count(F.lit(1)).alias("node_count"), F.count_distinct("file_id").alias("file_count"))
