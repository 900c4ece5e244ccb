"""Tree structure: edges, termini, slabs and validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..model import AXON, SOMA, all_finite
from ..session import keep_keys, lookup_join, settle, union_all

TERMINUS_TYPES = (AXON,)


def edges(nodes: DataFrame, file_ids=None) -> DataFrame:
    """Child-parent pairs whose parent exists; the key (file, parent) spreads one large tree over all tasks."""
    if file_ids is not None:
        nodes = keep_keys(nodes, file_ids)
    child = nodes.select(
        "file_id", "node_id", "parent_id", "type", *[F.col(c).alias(f"{c}1") for c in "xyz"]
    ).filter(F.col("parent_id").isNotNull())
    parent = nodes.select(
        "file_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"{c}2") for c in "xyz"]
    )
    return child.join(parent, ["file_id", "parent_id"]).select(
        "file_id", "node_id", "parent_id", "type", "x1", "y1", "z1", "x2", "y2", "z2"
    )


def childless(nodes: DataFrame) -> DataFrame:
    """Nodes that no row of the same file names as parent, whatever its type."""
    parents = nodes.select("file_id", F.col("parent_id").alias("node_id")).filter(F.col("node_id").isNotNull()).distinct()
    return nodes.join(parents, ["file_id", "node_id"], "left_anti")


def termini(nodes: DataFrame, types: Iterable[int] | None = TERMINUS_TYPES, file_ids=None) -> DataFrame:
    scoped = nodes if file_ids is None else keep_keys(nodes, file_ids)
    if types is None:
        return childless(scoped)
    parents = scoped.select("file_id", F.col("parent_id").alias("node_id")).filter(F.col("node_id").isNotNull()).distinct()
    wanted = scoped.filter(F.col("type").isin([int(t) for t in types]))
    return wanted.join(parents, ["file_id", "node_id"], "left_anti")


def termini_coverage(nodes: DataFrame, types: Iterable[int] | None = TERMINUS_TYPES, file_ids=None) -> DataFrame:
    """Childless nodes per file: of the chosen types and of others."""
    scoped = nodes if file_ids is None else keep_keys(nodes, file_ids)
    hit = F.lit(True) if types is None else F.coalesce(F.col("type").isin([int(t) for t in types]), F.lit(False))
    return childless(scoped.select("file_id", "node_id", "parent_id", "type")).groupBy("file_id").agg(
        F.count_if(hit).alias("termini"), F.count_if(~hit).alias("other_childless")
    )


def coverage_report(coverage: DataFrame) -> dict:
    """Totals of a coverage table; ``files_without_termini`` lists the files."""
    return coverage.agg(
        F.count(F.lit(1)).alias("cells_requested"), F.coalesce(F.sum("termini"), F.lit(0)).alias("termini_found"),
        F.coalesce(F.sum("other_childless"), F.lit(0)).alias("childless_nodes_excluded"),
        F.count_if(F.col("termini") > 0).alias("cells_with_selected_types"),
        F.count_if(F.col("termini") == 0).alias("cells_without_selected_types"),
    ).first().asDict()


def files_without_termini(coverage: DataFrame) -> DataFrame:
    """All files that have no terminus of the chosen types."""
    return coverage.filter("termini = 0").select("file_id")


def slab_segments(tree_edges: DataFrame, axis: str, position: float, tolerance: float) -> DataFrame:
    """Edges that meet the slab, with both ends moved onto its middle plane."""
    a, b, p = F.col(f"{axis}1"), F.col(f"{axis}2"), F.lit(float(position))
    meets = (F.greatest(a, b) >= float(position - tolerance)) & (F.least(a, b) <= float(position + tolerance))
    return tree_edges.filter(meets).withColumns({f"{axis}1": p, f"{axis}2": p})


def unreached_nodes(nodes: DataFrame, dangling: DataFrame | None = None) -> DataFrame:
    """(file_id, n): nodes whose ancestors never lead to a root.

    Where every parent exists and has a smaller id than its child, ids fall along each chain, so it ends at a root.
    Only the other files, found by one aggregate and one anti join, are followed node by node.
    """
    late = nodes.filter((F.col("parent_id") != -1) & (F.col("parent_id") >= F.col("node_id"))).select("file_id")
    loose = node_places(nodes).filter("dangling > 0") if dangling is None else dangling
    suspects = settle(late.unionByName(loose.select("file_id")).distinct())
    if not suspects.limit(1).count():
        return nodes.sparkSession.createDataFrame([], "file_id string, n long")
    chosen = lookup_join(nodes.select("file_id", "node_id", "parent_id"), suspects, "file_id", "left_semi", salt_by=["node_id"])
    return reachable_counts(chosen).select("file_id", (F.col("total") - F.col("reached")).alias("n"))


def node_places(nodes: DataFrame) -> DataFrame:
    """(file_id, repeated, dangling) per file: rows that repeat a node id, and rows whose parent is not in the file.

    A row stands once for its node and once for its parent; one exchange brings both kinds together.
    """
    roles = F.array(
        F.struct(F.col("node_id").alias("id"), F.lit(1).alias("own"), F.lit(0).alias("link")),
        F.struct(F.col("parent_id").alias("id"), F.lit(0).alias("own"), F.lit(1).alias("link")),
    )
    rows = nodes.select("file_id", F.explode(roles).alias("r")).select("file_id", "r.*")
    rows = rows.filter((F.col("own") == 1) | (F.col("id") != -1))
    met = rows.groupBy("file_id", "id").agg(F.sum("own").alias("own"), F.sum("link").alias("link"))
    return met.groupBy("file_id").agg(
        F.sum(F.greatest(F.col("own") - 1, F.lit(0))).alias("repeated"), F.sum(F.when(F.col("own") == 0, F.col("link")).otherwise(0)).alias("dangling"))


def reachable_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per file whose ancestor chain ends at a root, by pointer doubling.

    Each round joins a node with the node its pointer names, so a chain of d nodes takes log2(d) rounds.
    A pointer is done at a root (-1) or at a missing parent (-2); the pointers of a cycle never finish, which
    shows when a round finishes no further node.
    """
    ids = nodes.groupBy("file_id", "node_id").agg(F.min("parent_id").alias("up"))
    here = ids.select("file_id", F.col("node_id").alias("up"), F.lit(True).alias("found"))
    state = settle(ids.join(here, ["file_id", "up"], "left").select(
        "file_id", "node_id",
        F.when(F.col("up") == -1, -1).when(F.col("found"), F.col("up")).otherwise(-2).alias("up"),
    ))
    still_open, before = state.filter("up >= 0").count(), -1
    while still_open and still_open != before:
        jump = state.select("file_id", F.col("node_id").alias("up"), F.col("up").alias("next"))
        moved = state.filter("up >= 0").join(jump, ["file_id", "up"]).select("file_id", "node_id", F.col("next").alias("up"))
        state = settle(state.filter("up < 0").unionByName(moved), replaces=state)
        still_open, before = state.filter("up >= 0").count(), still_open
    return state.groupBy("file_id").agg(F.count_if(F.col("up") == -1).alias("reached"), F.count(F.lit(1)).alias("total"))


def validate_trees(nodes: DataFrame, structures: DataFrame) -> DataFrame:
    """One row (file_id, issue, n) per broken rule; no rows means every tree is sound."""
    ints = ("node_id", "type", "parent_id", "region_id")
    known = structures.select(F.col("id").alias("region_id")).distinct()
    places = settle(node_places(nodes))
    duplicates = places.select("file_id", F.lit("duplicate node_id").alias("issue"), F.col("repeated").alias("n"))
    null_field = F.lit(False)
    for name in ints:
        null_field = null_field | F.col(name).isNull()
    per_file = nodes.groupBy("file_id").agg(
        F.count_if(null_field).alias("null value"),
        F.count_if(~all_finite("x", "y", "z")).alias("coordinate not finite"),
        F.count_if(F.col("region_id") < 0).alias("negative region_id"),
        F.count_if(F.col("parent_id") == -1).alias("_roots"),
        F.count_if(F.col("type") == SOMA).alias("_somas"),
        F.count_if((F.col("type") == SOMA) & (F.col("parent_id") != -1)).alias("_soma_not_root"),
    )
    checks = {
        "null value": F.col("null value"), "coordinate not finite": F.col("coordinate not finite"),
        "negative region_id": F.col("negative region_id"),
        "not exactly one root": F.when(F.col("_roots") != 1, F.greatest(F.col("_roots"), F.lit(1))).otherwise(0),
        "not exactly one soma": F.when(F.col("_somas") != 1, F.greatest(F.col("_somas"), F.lit(1))).otherwise(0),
        "soma is not the root": F.when(F.col("_somas") == 1, F.col("_soma_not_root")).otherwise(0),
    }
    simple = per_file.select("file_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("issue"), v.cast("long").alias("n")) for k, v in checks.items()
    ])).alias("i")).select("file_id", "i.issue", "i.n")
    used = nodes.filter(F.col("region_id") != 0).groupBy("file_id", "region_id").agg(F.count(F.lit(1)).alias("c"))
    unknown = lookup_join(used, known, "region_id", "left_anti").groupBy("file_id").agg(F.sum("c").alias("n")).select(
        "file_id", F.lit("unknown region_id").alias("issue"), "n"
    )
    dangling = places.select("file_id", F.lit("dangling parent_id").alias("issue"), F.col("dangling").alias("n"))
    unreached = unreached_nodes(nodes, places.filter("dangling > 0")).select("file_id", F.lit("not connected to the root").alias("issue"), "n")
    return union_all([simple, duplicates, unknown, dangling, unreached]).filter("n > 0").select(
        "file_id", "issue", F.col("n").cast("long").alias("n")
    )
