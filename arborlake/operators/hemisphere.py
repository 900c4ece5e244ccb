"""Hemisphere alignment of whole files and checks of a mirrored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import side_of
from ..model import SOMA
from ..session import lookup_join

TOLERANCE_UM = 1.0


def soma_sides(nodes: DataFrame, axis: str, midline: float, target: str | None) -> DataFrame:
    """Per file: side of the mean soma coordinate and what alignment does with the file."""
    files = nodes.groupBy("file_id").agg(F.avg(F.when(F.col("type") == SOMA, F.col(axis))).alias("soma"))
    side = side_of("soma", midline, TOLERANCE_UM)
    outcome = (
        F.when(F.col("soma").isNull(), "no soma").when(F.col("side") == "midline", "midline")
        .when(F.lit(target is None) | (F.col("side") == F.lit(target or "")), "already target").otherwise("flipped")
    )
    return files.withColumn("side", F.when(F.col("soma").isNotNull(), side)).withColumn("outcome", outcome)


def align_hemisphere(nodes: DataFrame, target: str, midline: float, axis: str = "z"):
    """(aligned nodes, per-file outcome). Files on the other side are mirrored whole; files without a soma fail."""
    if target not in ("left", "right"):
        raise ValueError("target is left or right")
    sides = soma_sides(nodes, axis, midline, target)
    joined = lookup_join(
        nodes, sides.filter("outcome <> 'no soma'").select("file_id", "outcome"), "file_id", salt_by=["node_id"], check=False
    )
    moved = F.when(F.col("outcome") == "flipped", F.lit(2.0 * midline) - F.col(axis)).otherwise(F.col(axis))
    return joined.withColumn(axis, moved).select(*nodes.columns), sides


def mirror_nodes(nodes: DataFrame, midline: float, axis: str = "z") -> DataFrame:
    return nodes.withColumn(axis, F.lit(2.0 * midline) - F.col(axis))


_TEXT = ("type", "parent_id", "region_id", "region_name", "region_acronym", "subject", "neuron_id")
_NUMBER = ("x", "y", "z", "radius")


def positional_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables side by side by (file_id, node_id); ``l`` or ``r`` is null when a side lacks the node."""
    pack = lambda df, name: df.select("file_id", "node_id", F.struct(*df.columns).alias(name))
    return pack(left, "l").join(pack(right, "r"), ["file_id", "node_id"], "full_outer")


def mirror_differences(pairs: DataFrame, axis: str = "z", tolerance: float = 1e-6) -> DataFrame:
    """One row: differing values per column and the range of the mirrored coordinate sums."""
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    has = {f.name for f in pairs.schema["l"].dataType} & {f.name for f in pairs.schema["r"].dataType}
    total = F.col(f"l.{axis}") + F.col(f"r.{axis}")
    gap = lambda c: F.abs(F.col(f"l.{c}") - F.col(f"r.{c}"))
    out = [
        F.count_if(both).alias("total_rows"), F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
    ]
    out += [F.count_if(both & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(f"diff_{c}") for c in _TEXT if c in has]
    out += [F.count_if(gap(c) > tolerance).alias(f"diff_{c}") for c in _NUMBER if c in has]
    out += [
        F.count_if(gap(axis) <= tolerance).alias("equal_axis_rows"), F.min(total).alias("min_axis_sum"),
        F.max(total).alias("max_axis_sum"),
    ]
    return pairs.agg(*out)


def mirror_error(pairs: DataFrame, expected_sum: float, axis: str = "z", tolerance: float = 1e-6) -> DataFrame:
    off = F.abs(F.col(f"l.{axis}") + F.col(f"r.{axis}") - F.lit(float(expected_sum)))
    return pairs.agg(F.count_if(off > tolerance).alias("bad_mirror_sum"), F.max(off).alias("max_mirror_error"))


def _changed(pairs: DataFrame) -> DataFrame:
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    return pairs.filter(both & ~F.col("l.region_id").eqNullSafe(F.col("r.region_id")))


def top_remaps(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent region changes."""
    return (
        _changed(pairs).groupBy(F.col("l.region_acronym").alias("left_region"), F.col("r.region_acronym").alias("right_region"))
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "left_region", "right_region").limit(limit)
    )


def mismatch_sample(pairs: DataFrame, axis: str = "z", limit: int = 10) -> DataFrame:
    return _changed(pairs).select(
        "file_id", "node_id", F.col("l.region_id").alias("left_region_id"), F.col("r.region_id").alias("right_region_id"),
        F.col(f"l.{axis}").alias("left_axis"), F.col(f"r.{axis}").alias("right_axis"),
        (F.col(f"l.{axis}") + F.col(f"r.{axis}")).alias("axis_sum"),
    ).orderBy("file_id", "node_id").limit(limit)


def coordinate_ranges(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


def mirror_qa(left: DataFrame, right: DataFrame, axis: str = "z", tolerance: float = 1e-6, expected_sum: float | None = None) -> DataFrame:
    """Differences, mirror error and coordinate ranges of two tables in one row."""
    pairs = positional_compare(left, right)
    differences = mirror_differences(pairs, axis, tolerance)
    if expected_sum is None:
        row = differences.select("min_axis_sum", "max_axis_sum").first()
        expected_sum = 0.5 * (row[0] + row[1])
    error = mirror_error(pairs, expected_sum, axis, tolerance)
    share = F.try_divide(F.col("diff_region_id").cast("double"), F.col("total_rows"))
    out = differences.withColumns({"expected_axis_sum": F.lit(float(expected_sum)), "region_mismatch_share": share})
    bad, worst = error.select("bad_mirror_sum").scalar(), error.select("max_mirror_error").scalar()
    return out.withColumns({"bad_mirror_sum": bad, "max_mirror_error": worst})
