"""Labelled point tables: groups, selections, heatmaps and checks against the atlas."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import origin_form, region_name_form
from ..model import Grid, all_finite
from ..session import lookup_join
from .blocks import at_voxels


def point_group_summary(points: DataFrame) -> DataFrame:
    """Points per label and origin."""
    origin = origin_form("origin_csv") if "origin_csv" in points.columns else F.lit("(not recorded)")
    return points.groupBy(F.trim("label").alias("label"), origin.alias("origin_csv")).agg(
        F.count(F.lit(1)).alias("point_count")
    ).orderBy("origin_csv", "label")


def points_selection(points: DataFrame, selections: Iterable[tuple[str, str | None]]) -> DataFrame:
    """Rows of (label, origin) pairs; an empty origin stands for rows without one."""
    wanted = {(str(a).strip(), (str(b).strip() if b is not None else "") or "(not recorded)") for a, b in selections}
    wanted = sorted(w for w in wanted if w[0])
    keys = points.sparkSession.createDataFrame(wanted, "_label string, _origin string")
    origin = origin_form("origin_csv") if "origin_csv" in points.columns else F.lit("(not recorded)")
    rows = points.withColumns({"_label": F.trim("label"), "_origin": origin})
    return lookup_join(rows, keys, ["_label", "_origin"], "left_semi").drop("_label", "_origin")


def point_voxel(grid: Grid) -> tuple[Column, Column, Column]:
    """Point tables map z, y, x to axes 0, 1, 2 and round half to even."""
    return tuple(F.rint(F.col(c) / F.lit(r)).cast("long") for c, r in zip("zyx", grid.resolution))


def point_heatmaps(points: DataFrame, grid: Grid, group: Sequence[str] = ("label",)) -> DataFrame:
    """Points per group and voxel; rows off the grid do not count."""
    def key(name: str) -> Column:
        if name == "origin_csv":
            return origin_form(name)
        return F.trim(name) if dict(points.dtypes)[name] == "string" else F.col(name)

    ai, bi, ci = point_voxel(grid)
    rows = points.filter(all_finite("x", "y", "z")).withColumns({"ai": ai, "bi": bi, "ci": ci}).filter(grid.holds())
    return rows.groupBy(*[key(g).alias(g) for g in group], "ai", "bi", "ci").agg(F.count(F.lit(1)).alias("n"))


def _text(value: Column | str) -> Column:
    return F.trim(F.col(value) if isinstance(value, str) else value)


def validate_points_atlas(points: DataFrame, annotation: DataFrame, structures: DataFrame, grid: Grid) -> DataFrame:
    """All points with the atlas' region, hemisphere and the list of supplied fields that disagree ('' if none)."""
    ai, bi, ci = point_voxel(grid)
    volume = annotation.filter(grid.holds()).select(grid.linear().alias("_voxel"), F.col("region_id").alias("atlas_id"))
    rows = points.withColumn("_voxel", F.when(all_finite("x", "y", "z") & grid.holds(ai, bi, ci), grid.linear(ai, bi, ci)))
    rows = at_voxels(rows, "_voxel", volume, grid, ["atlas_id"]).drop("_voxel").withColumn("atlas_id", F.coalesce("atlas_id", F.lit(0)))
    names = structures.select(F.col("id").alias("atlas_id"), F.col("name").alias("atlas_region_name"), F.col("acronym").alias("atlas_acronym"))
    rows = lookup_join(rows, names, "atlas_id", "left").na.fill("", ["atlas_region_name", "atlas_acronym"])
    z, mid = F.col("z"), grid.mirror_point
    side = F.when(z < mid - 1.0, "left").when(z > mid + 1.0, "right").otherwise("midline")
    rows = rows.withColumn("atlas_hemisphere", side)
    given = lambda c: F.col(c).isNotNull() & (_text(c) != "")
    checks = {
        "id": F.col("id").isNotNull() & (F.col("id") != F.col("atlas_id")),
        "acronym": given("acronym") & (_text("acronym") != _text("atlas_acronym")),
        "region_name": given("region_name") & (region_name_form("region_name") != region_name_form("atlas_region_name")),
        "hemisphere": given("hemisphere") & (F.lower(_text("hemisphere")) != F.col("atlas_hemisphere")),
    }
    fields = F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in checks.items() if name in points.columns])
    return rows.withColumn("mismatch_fields", fields)


def mismatches(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("mismatch_fields") != "")


def mismatch_counts(checked: DataFrame) -> DataFrame:
    """One row: points, mismatched rows and mismatches per field."""
    parts = F.split("mismatch_fields", ",")
    return checked.agg(
        F.count(F.lit(1)).alias("total_points"), F.count_if(F.col("mismatch_fields") != "").alias("mismatched_rows"),
        *[F.count_if(F.array_contains(parts, f)).alias(f"{f}_mismatches") for f in ("id", "acronym", "region_name", "hemisphere")],
    )
