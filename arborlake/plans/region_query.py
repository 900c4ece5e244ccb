"""Boolean region queries over the regional profile.

Every condition is a per-file aggregate of profile rows, so a whole query tree is one grouped scan with one
conditional aggregate per condition; AND, OR and NOT combine its columns. The set form (intersect, union, except
of file lists) gives the same files with one scan and shuffle per condition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..model import LATERALITIES
from ..session import frame_of, keep_keys, lookup_join, union_all

EITHER = "either"
COMPARISONS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b,
    ">=": lambda a, b: a >= b, ">": lambda a, b: a > b,
}
MEASURES = ("cable_length_um", "node_count", "terminus_count")


@dataclass(frozen=True)
class Regions:
    """Selected regions, by default with all their descendants."""

    ids: tuple[int, ...]
    descendants: bool = True

    def __post_init__(self):
        object.__setattr__(self, "ids", tuple(sorted({int(i) for i in self.ids})))
        if not self.ids:
            raise ValueError("select at least one region")


def _side(value: str) -> str:
    if value != EITHER and value not in LATERALITIES:
        raise ValueError(f"unknown side {value!r}")
    return value


@dataclass(frozen=True)
class SomaIn:
    regions: Regions
    kind = "soma_in"


@dataclass(frozen=True)
class NeuriteIn:
    regions: Regions
    laterality: str = EITHER
    kind = "neurite_intersects"

    def __post_init__(self):
        _side(self.laterality)


@dataclass(frozen=True)
class Threshold:
    """Sum of a measure over regions and side compared with a value; no rows is 0."""

    regions: Regions
    measure: str
    comparison: str
    value: float
    compartment: str = "neurite"
    laterality: str = EITHER
    kind = "regional_threshold"

    def __post_init__(self):
        _side(self.laterality)
        if self.measure not in MEASURES or self.comparison not in COMPARISONS or self.compartment not in ("soma", "neurite"):
            raise ValueError("unsupported threshold")
        if not math.isfinite(self.value) or self.value < 0:
            raise ValueError("the threshold value must be finite and not negative")


@dataclass(frozen=True)
class AllOf:
    children: tuple

    def __post_init__(self):
        if not self.children:
            raise ValueError("a group needs a child")


@dataclass(frozen=True)
class AnyOf:
    children: tuple

    def __post_init__(self):
        if not self.children:
            raise ValueError("a group needs a child")


@dataclass(frozen=True)
class Not:
    child: object


def conditions(tree, path: str = "query") -> list[tuple[str, object]]:
    """Leaves of a query tree with their paths."""
    if isinstance(tree, (AllOf, AnyOf)):
        return [leaf for i, child in enumerate(tree.children) for leaf in conditions(child, f"{path}.children[{i}]")]
    if isinstance(tree, Not):
        return conditions(tree.child, f"{path}.child")
    if not isinstance(tree, (SomaIn, NeuriteIn, Threshold)):
        raise ValueError(f"not a region query: {tree!r}")
    return [(path, tree)]


def resolve_selection(closure: DataFrame, regions: Regions) -> DataFrame:
    """Direct ids of a selection; an id outside the hierarchy is an error."""
    spark = closure.sparkSession
    chosen = frame_of(spark, regions.ids, "ancestor_region_id", "int")
    unknown = chosen.join(closure.select("ancestor_region_id").distinct(), "ancestor_region_id", "left_anti").collect()
    if unknown:
        raise ValueError(f"unknown regions {sorted(r[0] for r in unknown)}")
    if not regions.descendants:
        return chosen.select(F.col("ancestor_region_id").alias("region_id"))
    return closure.join(chosen, "ancestor_region_id", "left_semi").select(F.col("direct_region_id").alias("region_id")).distinct()


def _resolve(closure: DataFrame, tree) -> dict[Regions, list[int]]:
    """Direct ids of every selection of a tree from one job; their number is bounded by the ontology."""
    selections = {c.regions for _, c in conditions(tree)}
    wanted = sorted({i for s in selections for i in s.ids})
    rows = closure.filter(F.col("ancestor_region_id").isin(wanted)).select("ancestor_region_id", "direct_region_id").collect()
    below: dict[int, set[int]] = {}
    for row in rows:
        below.setdefault(row[0], set()).add(row[1])
    unknown = [i for i in wanted if i not in below]
    if unknown:
        raise ValueError(f"unknown regions {unknown}")
    return {s: sorted(set().union(*(below[i] for i in s.ids)) if s.descendants else set(s.ids)) for s in selections}


def query_explain(closure: DataFrame, tree) -> DataFrame:
    """One row per condition with its selected and resolved region ids."""
    rows, resolved = [], _resolve(closure, tree)
    for path, c in conditions(tree):
        compartment = "soma" if isinstance(c, SomaIn) else getattr(c, "compartment", "neurite")
        rows.append((
            path, c.kind, list(c.regions.ids), c.regions.descendants, resolved[c.regions], compartment,
            getattr(c, "laterality", EITHER), getattr(c, "measure", None), getattr(c, "comparison", None),
            float(c.value) if isinstance(c, Threshold) else None,
        ))
    return closure.sparkSession.createDataFrame(rows, (
        "path string, kind string, selected_ids array<int>, descendants boolean, resolved_ids array<int>, compartment string, "
        "laterality string, measure string, comparison string, value double"
    ))


def _rows_of(condition, ids: Sequence[int]) -> Column:
    """Profile rows a condition looks at."""
    compartment = "soma" if isinstance(condition, SomaIn) else getattr(condition, "compartment", "neurite")
    test = (F.col("compartment") == compartment) & F.col("region_id").isin(list(ids))
    side = getattr(condition, "laterality", EITHER)
    return test if side == EITHER else test & (F.col("laterality") == side)


def _aggregate(condition, ids: Sequence[int]) -> Column:
    rows = _rows_of(condition, ids)
    if isinstance(condition, SomaIn):
        return F.coalesce(F.bool_or(rows & (F.col("node_count") > 0)), F.lit(False))
    if isinstance(condition, NeuriteIn):
        return F.coalesce(F.bool_or(rows & ((F.col("node_count") > 0) | (F.col("cable_length_um") > 0))), F.lit(False))
    total = F.coalesce(F.sum(F.when(rows, F.col(condition.measure))), F.lit(0))
    return COMPARISONS[condition.comparison](total, F.lit(condition.value))


def _combine(tree, leaves: dict[str, Column], path: str = "query") -> Column:
    if isinstance(tree, Not):
        return ~_combine(tree.child, leaves, f"{path}.child")
    if isinstance(tree, (AllOf, AnyOf)):
        out = None
        for i, child in enumerate(tree.children):
            part = _combine(child, leaves, f"{path}.children[{i}]")
            out = part if out is None else (out & part if isinstance(tree, AllOf) else out | part)
        return out
    return leaves[path]


def matching_files(profile: DataFrame, closure: DataFrame, tree, scope=None) -> DataFrame:
    """file_ids of the scope that satisfy the tree; an explicit scope is cut to the profile's files."""
    rows = profile if scope is None else keep_keys(profile, scope)
    leaves, outputs, resolved = {}, [], _resolve(closure, tree)
    for i, (path, condition) in enumerate(conditions(tree)):
        outputs.append(_aggregate(condition, resolved[condition.regions]).alias(f"_c{i}"))
        leaves[path] = F.col(f"_c{i}")
    grouped = rows.groupBy("file_id").agg(*outputs)
    return grouped.filter(_combine(tree, leaves)).select("file_id")


def matching_files_by_sets(profile: DataFrame, closure: DataFrame, tree, scope=None) -> DataFrame:
    """The same files from set operations on one file list per condition."""
    universe = (profile if scope is None else keep_keys(profile, scope)).select("file_id").distinct()
    resolved = _resolve(closure, tree)

    def build(node) -> DataFrame:
        if isinstance(node, AllOf):
            out = build(node.children[0])
            for child in node.children[1:]:
                out = out.intersect(build(child))
            return out
        if isinstance(node, AnyOf):
            return union_all([build(child) for child in node.children]).distinct()
        if isinstance(node, Not):
            return universe.subtract(build(node.child))
        ids = resolved[node.regions]
        if isinstance(node, Threshold):
            return threshold_left_join(profile, universe, node, ids)
        rows = profile.filter(_rows_of(node, ids))
        present = F.col("node_count") > 0
        if isinstance(node, NeuriteIn):
            present = present | (F.col("cable_length_um") > 0)
        return rows.filter(present).select("file_id").distinct()

    return universe.intersect(build(tree))


def threshold_left_join(profile: DataFrame, universe: DataFrame, condition: Threshold, ids: Sequence[int]) -> DataFrame:
    """Universe LEFT JOIN the condition's rows, folded to one sum per file first, so absent files count as 0."""
    sums = profile.filter(_rows_of(condition, ids)).groupBy("file_id").agg(F.sum(condition.measure).alias("total"))
    joined = universe.join(sums, "file_id", "left")
    return joined.filter(COMPARISONS[condition.comparison](F.coalesce("total", F.lit(0)), F.lit(condition.value))).select("file_id")


def region_query(profile: DataFrame, closure: DataFrame, catalog: DataFrame, tree, scope=None) -> DataFrame:
    """Matches with their catalog names; ``has_catalog`` is false for ids missing from the catalog."""
    found = matching_files(profile, closure, tree, scope)
    named = catalog.select("file_id", "neuron_id", "subject", F.lit(True).alias("has_catalog"))
    return found.join(named, "file_id", "left").withColumn("has_catalog", F.coalesce("has_catalog", F.lit(False))).orderBy("file_id")
