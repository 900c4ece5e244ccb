"""Similar-neuron search: rank candidates by 1 - r against the summed counts of reference neurons."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from ..model import Grid
from ..operators.catalog import neuron_catalog
from ..operators.filters import VoxelNodeFilter
from ..operators.flatmap import FlatGrid, flat_counts
from ..operators.pearson import POLICIES
from ..operators.volumes import lut_counts, scoped_nodes, voxel_counts
from ..session import forget, keep_keys, lookup_join, settle


@dataclass(frozen=True)
class VoxelSearch:
    """What to look for; ``space`` is ccf or flatmap."""

    references: tuple[str, ...]
    candidates: tuple[str, ...] | None = None
    top_n: int = 100
    exclude_references: bool = True
    space: str = "ccf"
    resolution_um: float = 25.0
    corrected: bool = True
    node_filter: VoxelNodeFilter | None = None
    flat: FlatGrid | None = None

    def __post_init__(self):
        if not self.references:
            raise ValueError("select at least one reference neuron")
        if self.top_n < 1 or not self.resolution_um > 0:
            raise ValueError("top_n and resolution must be positive")
        if self.space not in ("ccf", "flatmap") or (self.space == "flatmap" and self.flat is None):
            raise ValueError("space is ccf, or flatmap with a grid")

    @property
    def policy(self) -> str:
        return "flatmap" if self.space == "flatmap" else ("corrected" if self.corrected else "legacy")


def aggregate_query(counts: DataFrame, references: Sequence[str]) -> DataFrame:
    """Summed counts of the reference neurons per voxel."""
    return keep_keys(counts, references).groupBy("voxel").agg(F.sum(F.col("c").cast("double")).alias("q"))


def aggregate_query_join(counts: DataFrame, query: DataFrame) -> DataFrame:
    """Candidate counts with the query's count of the same voxel (0 where the query has none).

    The query has no more voxels than its neurons, so it is broadcast if its counted size allows.
    """
    joined = lookup_join(counts, query, "voxel", "left", salt_by=["file_id"])
    return joined.withColumn("q", F.coalesce("q", F.lit(0.0)))


def score(counts: DataFrame, references: Sequence[str], policy: str, candidates=None) -> DataFrame:
    """(file_id, pearson_distance) per candidate; the counts are grouped once, all sums come from one pass.

    V and the query's sums are scalar subqueries, so nothing is cross joined.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    query = aggregate_query(counts, references)
    rows = aggregate_query_join(counts if candidates is None else keep_keys(counts, candidates), query)
    c, q = F.col("c").cast("double"), F.col("q")
    sums = rows.groupBy("file_id").agg(
        F.sum(c).alias("sx"), F.sum(c * c).alias("sxx"), F.sum(c * q).alias("sxy"),
    )
    totals = query.agg(F.struct(F.sum("q").alias("sy"), F.sum(q * q).alias("syy"))).scalar()
    sums = sums.withColumns({"v": counts.agg(F.count_distinct("voxel").cast("double")).scalar(), "_query": totals})
    sums = sums.withColumns({"sy": F.col("_query.sy"), "syy": F.col("_query.syy")})
    v, sx, sxx, sxy = F.col("v"), F.col("sx"), F.col("sxx"), F.col("sxy")
    top = v * sxy - sx * F.col("sy")
    query_var = v * F.col("syy") - F.col("sy") * F.col("sy")
    spread = F.sqrt(F.greatest(v * sxx - sx * sx, F.lit(0.0)) * F.greatest(query_var, F.lit(0.0)))
    r = F.try_divide(top, F.nullif(spread, F.lit(0.0)))
    if policy == "legacy":
        r = F.when(sxy == 0, -1.0).otherwise(F.coalesce(r, F.lit(-1.0)))
    elif policy == "flatmap":
        r = F.coalesce(r, F.lit(0.0))
    else:
        r = F.when(query_var <= 0, F.raise_error(F.lit("the reference counts are constant")).cast("double")).otherwise(r)
    clipped = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
    return sums.select("file_id", (1.0 - clipped).alias("pearson_distance")).filter("pearson_distance IS NOT NULL")


def top_n_hits(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy("pearson_distance", "file_id").limit(n)


def result_rank(hits: DataFrame) -> DataFrame:
    """Rank 1..n of at most n hits."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy("pearson_distance", "file_id")))


def check_request(nodes: DataFrame, counts: DataFrame, request: VoxelSearch) -> None:
    """References must exist and have usable nodes, and a candidate must remain. The counts answer first."""
    ids = lambda rows: {r[0] for r in keep_keys(rows, request.references).select(F.col("file_id").cast("string")).distinct().collect()}
    unusable = set(request.references) - ids(counts)
    if unusable:
        missing = sorted(unusable - ids(nodes))
        raise ValueError(f"references not in the table: {missing}" if missing else f"references without usable nodes: {sorted(unusable)}")
    pool = counts if request.candidates is None else keep_keys(counts, request.candidates)
    if request.exclude_references:
        pool = keep_keys(pool, request.references, keep=False)
    if not pool.limit(1).count():
        raise ValueError("no candidate neurons")


def search_counts(
    nodes: DataFrame, request: VoxelSearch, grid: Grid | None = None, include: DataFrame | None = None,
    exclude: DataFrame | None = None, lut: DataFrame | None = None,
) -> DataFrame:
    """Counts of the whole scope, references included. Masks hold in either space: they are about where a node is."""
    scope = None if request.candidates is None else (*request.candidates, *request.references)
    if request.space == "flatmap":
        return flat_counts(nodes, request.flat, request.node_filter, grid, scope, include, exclude)
    rows = scoped_nodes(nodes, grid, scope, include, exclude, request.node_filter)
    return lut_counts(rows, grid, lut) if lut is not None else voxel_counts(rows, request.resolution_um)


def voxel_search(
    nodes: DataFrame, request: VoxelSearch, grid: Grid | None = None, include: DataFrame | None = None,
    exclude: DataFrame | None = None, lut: DataFrame | None = None, check: bool = True,
) -> DataFrame:
    """(rank, file_id, neuron_id, subject, pearson_distance) of the nearest candidates."""
    counts = settle(search_counts(nodes, request, grid, include, exclude, lut))
    if check:
        check_request(nodes, counts, request)
    scores = score(counts, request.references, request.policy, request.candidates)
    if request.exclude_references:
        scores = keep_keys(scores, request.references, keep=False)
    hits = settle(result_rank(top_n_hits(scores, request.top_n)))
    forget(counts)
    # only the names of the hits: the catalog is grouped after a semi join with at most top_n ids
    names = neuron_catalog(lookup_join(nodes, hits.select("file_id"), "file_id", "left_semi"))
    return hits.join(names, "file_id", "left").select("rank", "file_id", "neuron_id", "subject", "pearson_distance").orderBy("rank")


def search_omissions(
    nodes: DataFrame, request: VoxelSearch, grid: Grid | None = None, include: DataFrame | None = None,
    exclude: DataFrame | None = None, lut: DataFrame | None = None,
) -> DataFrame:
    """(file_id, reason) of candidates that cannot be ranked: without a usable node, or with counts that do not vary.

    Candidates whose counts do not vary are left out under the corrected policy alone; the others give them a fixed distance.
    """
    counts = settle(search_counts(nodes, request, grid, include, exclude, lut))
    pool = nodes.select(F.col("file_id").cast("string").alias("file_id")).distinct()
    if request.candidates is not None:
        pool = keep_keys(pool, request.candidates)
    if request.exclude_references:
        pool = keep_keys(pool, request.references, keep=False)
    c = F.col("c").cast("double")
    v = counts.agg(F.count_distinct("voxel").cast("double")).scalar()
    sums = counts.groupBy("file_id").agg(F.sum(c).alias("sx"), F.sum(c * c).alias("sxx")).withColumn("flat", v * F.col("sxx") - F.col("sx") * F.col("sx") <= 0)
    rows = pool.join(sums, "file_id", "left")
    flat = F.col("flat") if request.policy == "corrected" else F.lit(False)
    reason = F.when(F.col("sx").isNull(), "no usable node").when(flat, "zero variance")
    return rows.select("file_id", reason.alias("reason")).filter("reason IS NOT NULL")


def search_context(request: VoxelSearch) -> str:
    """The request as one canonical JSON text, stored with exported results."""
    values = {
        "reference_file_ids": list(request.references), "candidate_file_ids": request.candidates and list(request.candidates),
        "top_n": request.top_n, "exclude_references": request.exclude_references, "coordinate_space": request.space,
        "resolution_um": request.resolution_um, "pearson_policy": request.policy,
    }
    return json.dumps(values, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
