"""Regional profile: cable length, nodes and termini per file, region, side and compartment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import COMPARTMENTS, LATERALITIES, PROFILE_SCHEMA, SOMA, Grid
from .. import session as joins
from ..session import forget, lookup_join, settle
from .blocks import at_voxels, block_volume
from .catalog import voxel_of
from .portions import Folder, Group, Volume, whole_groups
from .topology import validate_trees

# Crossings closer than this in edge parameter are one corner.
GAP = 16 * 2.0**-52
ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE = 1e-9, 1e-12
# Node numbers of one file that meet in one task: an ordinary tree stays together, a huge one is spread.
NODE_GROUP = 65_536


def _crossings(axis: str, size: int, step: float) -> Column:
    """Edge parameters in (0, 1) where an axis' voxel planes are crossed."""
    a, b = F.col(f"{axis}1"), F.col(f"{axis}2")
    low, high, width = F.least(a, b), F.greatest(a, b), b - a
    first = F.greatest(F.lit(0).cast("long"), F.ceil(low / F.lit(step)))
    last = F.least(F.lit(size).cast("long"), F.floor(high / F.lit(step)))
    none = F.array().cast("array<double>")
    planes = F.when((first <= last) & (width != 0), F.sequence(first, F.greatest(first, last)))
    inner = F.filter(planes, lambda k: (k * F.lit(step) > low) & (k * F.lit(step) < high))
    return F.coalesce(F.transform(inner, lambda k: (k * F.lit(step) - a) / width), none)


def _cuts(rows: DataFrame, grid: Grid) -> Column:
    """Edge parameters 0 < … < 1 at which an edge changes voxel or side; an edge inside one voxel and side has none.

    Crossings closer than ``GAP`` become one cut, so no length is lost between them.
    """
    axis = "xyz"[grid.lr_axis]
    a, b, mid = F.col(f"{axis}1"), F.col(f"{axis}2"), F.lit(float(grid.midline_um))
    none = F.array().cast("array<double>")
    at = F.when(F.least(a, b) < mid, F.when(F.greatest(a, b) > mid, F.array((mid - a) / (b - a))))
    inside = F.lit(True)
    for name, step in zip("xyz", grid.resolution):
        inside = inside & (F.floor(F.col(f"{name}1") / F.lit(step)) == F.floor(F.col(f"{name}2") / F.lit(step)))
    crossings = F.concat(*[_crossings(n, s, r) for n, s, r in zip("xyz", grid.shape, grid.resolution)], F.coalesce(at, none))
    return F.when(inside & at.isNull(), none).otherwise(F.array_sort(F.filter(crossings, lambda t: (t > GAP) & (t < 1 - GAP))))


def _portions(rows: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``_p``, the array of (t0, t1) of an edge's portions, and its length ``_length``; an edge of no length has none."""
    squares = [F.pow(F.col(f"{n}2") - F.col(f"{n}1"), F.lit(2.0)) for n in "xyz"]
    rows = rows.withColumns({"_length": F.sqrt(squares[0] + squares[1] + squares[2]), "_inner": _cuts(rows, grid)})
    merged = F.filter("_inner", lambda t, i: (i == 0) | (t - F.get("_inner", i - 1) > F.lit(GAP)))
    rows = rows.withColumn("_inner", F.when(F.size("_inner") < 2, F.col("_inner")).otherwise(merged))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(0.0)), "_inner").alias("t0"), F.concat("_inner", F.array(F.lit(1.0))).alias("t1"))
    return rows.withColumn("_p", F.when(F.col("_length") > 0, pairs)).drop("_inner")


def _portion_place(grid: Grid) -> dict[str, Column]:
    """Voxel (null outside the grid) and physical side of the portion (t0, t1), by its middle."""
    axis = "xyz"[grid.lr_axis]
    a, b, mid = F.col(f"{axis}1"), F.col(f"{axis}2"), F.lit(float(grid.midline_um))
    t = (F.col("t0") + F.col("t1")) / F.lit(2.0)
    middle = {n: F.col(f"{n}1") + t * (F.col(f"{n}2") - F.col(f"{n}1")) for n in "xyz"}
    index = [F.floor(middle[n] / F.lit(r)) for n, r in zip("xyz", grid.resolution)]
    side = F.when((a == mid) & (b == mid), "midline").when(middle[axis] < mid, "lower").otherwise("upper")
    return {"voxel": F.when(grid.holds(*index), grid.linear(*index)), "side": side}


def split_edges(tree_edges: DataFrame, grid: Grid) -> DataFrame:
    """Cut every edge at voxel planes and the midline.

    Adds per portion t0, t1, length_um, its voxel (null outside the grid) and physical side; all from array
    expressions of the edge row, so an edge never leaves its task.
    """
    # the outer form: for the inner one Spark adds a filter that computes the array of cuts again, per element
    pieces = _portions(tree_edges, grid).select(*tree_edges.columns, "_length", F.inline_outer("_p")).filter("t0 IS NOT NULL")
    place = _portion_place(grid)
    return pieces.select(
        *tree_edges.columns, "t0", "t1", ((F.col("t1") - F.col("t0")) * F.col("_length")).alias("length_um"),
        place["voxel"].alias("voxel"), place["side"].alias("side"),
    )


def _compartment(kind: Column) -> Column:
    return F.when(kind == SOMA, "soma").otherwise("neurite")


def node_side(grid: Grid, suffix: str = "") -> Column:
    c, mid = F.col("xyz"[grid.lr_axis] + suffix), F.lit(float(grid.midline_um))
    return F.when(c == mid, "midline").when(c < mid, "lower").otherwise("upper")


def _families(nodes: DataFrame, fold=None, schema: str | None = None) -> DataFrame:
    """(file_id, own_type, own_region, x2, y2, z2, type, x1, y1, z1): a node with each of its children; without children, one row of nulls.

    These are the rows of a left join of nodes with their children by file and number. A join deals both sides by node, which spreads
    a file, and its rows would have to be gathered again. Here a node moves once, to the group of its number, and a second time only if
    its parent's is another; there it stands once for itself and once for its parent's child, and groups that lie together are worked off as arrays.
    ``fold`` makes rows of ``schema`` of whole groups in their place.
    """
    group = lambda name: F.floor(F.col(name) / F.lit(NODE_GROUP))
    has_parent = F.col("file_id").isNotNull() & (F.col("parent_id") != -1)
    groups = F.when(has_parent, F.array_distinct(F.array(group("node_id"), group("parent_id")))).otherwise(F.array(group("node_id")))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a node's portions outgrow its bytes, so tasks are not merged by them
    dealt = nodes.select("file_id", "node_id", "parent_id", "type", "region_id", *"xyz", F.explode(groups).alias("_group")).repartition(parts, "file_id", "_group")
    is_child = F.col("_child")
    met = dealt.withColumn("_child", F.explode(F.array(F.lit(False), F.lit(True))))
    met = met.filter(F.when(is_child, has_parent & (group("parent_id") == F.col("_group"))).otherwise(group("node_id").eqNullSafe(F.col("_group"))))
    met = met.select("file_id", "_group", "_child", F.when(is_child, F.col("parent_id")).otherwise(F.col("node_id")).alias("_key"), "type", "region_id", *"xyz")
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    names = [("file_id", "file_id"), ("own_type", "type"), ("own_region", "region_id"), *[(f"{c}2", c) for c in "xyz"], ("type", "type"), *[(f"{c}1", c) for c in "xyz"]]
    schema = schema or ", ".join(f"{name} {kinds[c]}" for name, c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes in whole_groups(batches):
            yield from [Group(nodes).rows()] if fold is None else fold(nodes)

    return met.sortWithinPartitions("file_id", "_group").mapInArrow(run, schema)


def tree_rows(nodes: DataFrame, annotation: DataFrame, grid: Grid) -> DataFrame:
    """(file_id, region_id, side, compartment, cable, termini): edges by the region of their portions, termini by their own.

    One meeting finds both: a node meets its children, each of which is an edge; a node that meets none is childless, and a
    terminus unless it is a soma. They meet by file and group of node numbers, where they are cut, so an ordinary file's
    portions are made in one task, in batches of edges as arrays (``portions``). A volume within the bound of a broadcast names
    their regions there, and what moves on is a few rows per file, not one per file and voxel, nor one per file and task; for a
    larger one cable is summed per voxel before the regions are looked up.
    """
    volume = annotation.filter(grid.holds() & (F.col("region_id") != 0)).select(grid.linear().alias("voxel"), "region_id")
    small = joins.fits_broadcast(volume)
    table = volume.toArrow() if small else None
    small = small and len(table["voxel"].unique()) == len(table)  # a voxel that repeats counts once per row
    known = Volume.of(grid, table["voxel"].to_numpy(), table["region_id"].to_numpy()) if small else None
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = f"file_id {kinds['file_id']}, place long, _end boolean, side string, compartment string, cable double, termini long"
    rows = _families(nodes, Folder(grid, GAP, known), schema)
    kind = "long" if "bigint" in (kinds["region_id"], annotation.schema["region_id"].dataType.simpleString()) else "int"
    if small:
        joined = rows.withColumn("region_id", F.col("place").cast(kind))
    else:
        sums = rows.groupBy("file_id", "place", "side", "compartment", "_end").agg(F.sum("cable").alias("cable"), F.sum("termini").alias("termini"))
        sums = sums.withColumn("voxel", F.when(~F.col("_end"), F.col("place")))
        # blocks crowded with nodes are crowded with their cable, and nodes need no join to be counted
        blocks = block_volume(volume, grid, "voxel", ["region_id"])
        joined = at_voxels(sums, "voxel", blocks, grid, ["region_id"], salt_by=["file_id", "side"], summary=voxel_of(nodes, grid, "voxel"))
        joined = joined.withColumn("region_id", F.when(F.col("_end"), F.col("place").cast(kind)).otherwise(F.coalesce("region_id", F.lit(0))))
    return joined.groupBy("file_id", "region_id", "side", "compartment").agg(F.sum("cable").alias("cable"), F.sum("termini").alias("termini"))


def node_rows(nodes: DataFrame, grid: Grid) -> DataFrame:
    """(file_id, region_id, side, compartment, nodes): counts alone, so nothing but partial sums moves."""
    return nodes.groupBy("file_id", "region_id", node_side(grid).alias("side"), _compartment(F.col("type")).alias("compartment")).agg(F.count(F.lit(1)).alias("nodes"))


def soma_sides(nodes: DataFrame, grid: Grid) -> DataFrame:
    """Physical side of the soma; null when it lies outside the left-right extent."""
    c = F.col("xyz"[grid.lr_axis])
    inside = (c >= 0) & (c < F.lit(float(grid.extent[grid.lr_axis])))
    return nodes.filter(F.col("type") == SOMA).groupBy("file_id").agg(F.min(F.when(inside, node_side(grid))).alias("soma_side"))


def build_profile(nodes: DataFrame, annotation: DataFrame, structures: DataFrame, grid: Grid, validate: bool = True) -> DataFrame:
    """The profile of valid trees; with ``validate`` the first broken rules raise.

    Sides are relative to the soma, so they are resolved after both parts are folded to a few rows per file: the node
    table is never joined with the soma table, and its rows move once.
    """
    if validate:
        issues = settle(validate_trees(nodes, structures))
        totals = {r["issue"]: (r["files"], r["n"]) for r in issues.groupBy("issue").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("n")).collect()}
        if totals:
            first = issues.agg(F.min(F.struct("file_id", "issue"))).first()[0]
            what = "; ".join(f"{issue}: {n} in {files} files" for issue, (files, n) in sorted(totals.items()))
            raise ValueError(f"trees failed validation: {what}; the first is {first['file_id']}: {first['issue']}")
        foreign = annotation.select("region_id").distinct().filter("region_id <> 0").join(
            structures.select(F.col("id").alias("region_id")), "region_id", "left_anti").agg(
            F.count(F.lit(1)).alias("n"), F.min("region_id").alias("first")).first()
        if foreign["n"]:
            raise ValueError(f"{foreign['n']} annotation regions absent from the hierarchy, the smallest is {foreign['first']}")
    trees = tree_rows(nodes, annotation, grid).withColumn("nodes", F.lit(0).cast("long"))
    counted = node_rows(nodes, grid).withColumns({"cable": F.lit(0.0), "termini": F.lit(0).cast("long")})
    rows = trees.unionByName(counted)
    rows = lookup_join(rows, soma_sides(nodes, grid), "file_id", "left", salt_by=["region_id", "side"], check=False)
    known = F.coalesce(F.col("soma_side").isin("lower", "upper"), F.lit(False))
    laterality = (
        F.when(F.col("side") == "midline", "midline").when(~known, "unknown")
        .when(F.col("side") == F.col("soma_side"), "ipsilateral").otherwise("contralateral")
    )
    return rows.groupBy("file_id", "region_id", laterality.alias("laterality"), "compartment").agg(
        F.sum("cable").alias("cable_length_um"), F.sum("nodes").alias("node_count"), F.sum("termini").alias("terminus_count")
    )


@dataclass(frozen=True)
class ProfileTotals:
    """What a profile has to conserve."""

    files: int
    nodes: int
    edges: int
    zero_length_edges: int
    termini: int
    cable_um: float


def source_totals(nodes: DataFrame) -> ProfileTotals:
    child = nodes.select("file_id", "parent_id", *[F.col(c).alias(f"{c}1") for c in "xyz"])
    parent = nodes.select("file_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    squares = [F.pow(F.col(f"{c}2") - F.col(f"{c}1"), F.lit(2.0)) for c in "xyz"]
    lengths = child.join(parent, ["file_id", "parent_id"]).select(F.sqrt(squares[0] + squares[1] + squares[2]).alias("d"))
    cable = lengths.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") == 0).alias("zero"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("d")).first()
    parents = nodes.filter("parent_id <> -1").select("file_id", F.col("parent_id").alias("node_id")).distinct()
    ends = nodes.filter(F.col("type") != SOMA).join(parents, ["file_id", "node_id"], "left_anti").count()
    count = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("f")).first()
    return ProfileTotals(count["f"], count["n"], cable["n"], cable["zero"], ends, float(cable["d"]))


def validate_profile(profile: DataFrame) -> DataFrame:
    """One row of totals and violations: rows, distinct keys, sums and invalid rows."""
    keys = profile.groupBy("file_id", "region_id", "laterality", "compartment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("node_count").alias("nodes"), F.sum("terminus_count").alias("termini"),
        F.sum("cable_length_um").alias("cable"),
        F.count_if(
            (F.col("region_id") < 0) | (F.col("cable_length_um") < 0) | (F.col("node_count") < 0) | (F.col("terminus_count") < 0)
            | ~F.col("laterality").isin(list(LATERALITIES)) | ~F.col("compartment").isin(list(COMPARTMENTS))
        ).alias("bad"),
    )
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero))
    return keys.agg(
        total("rows", 0).alias("row_count"), F.count(F.lit(1)).alias("unique_keys"), total("nodes", 0).alias("node_count"),
        total("termini", 0).alias("terminus_count"), total("cable", 0.0).alias("cable_length_um"), total("bad", 0).alias("invalid_rows"),
    )


def profile_issues(profile: DataFrame, totals: ProfileTotals) -> list[str]:
    """What a profile breaks: duplicate or invalid rows and totals that are not conserved."""
    row = validate_profile(profile).first()
    checks = {
        "duplicate bucket keys": row["unique_keys"] != row["row_count"], "invalid rows": row["invalid_rows"] > 0,
        "node total": row["node_count"] != totals.nodes, "terminus total": row["terminus_count"] != totals.termini,
        "cable total": not math.isclose(row["cable_length_um"], totals.cable_um, rel_tol=RELATIVE_TOLERANCE, abs_tol=ABSOLUTE_TOLERANCE),
    }
    return [name for name, broken in checks.items() if broken]


def canonical_profile(profile: DataFrame) -> DataFrame:
    return profile.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PROFILE_SCHEMA])


ORDER = ("region_id", "laterality", "compartment", "file_id")


ROW_GROUP = 122_880


def write_profile(profile: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet ordered by region first, in row groups of bounded length, so that a query on few regions skips most of them."""
    ready = canonical_profile(profile).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ready.write.mode(mode).option("compression", "zstd").option("parquet.block.row.count.limit", str(ROW_GROUP)).parquet(path)


def _facts(nodes: DataFrame, annotation: DataFrame, structures: DataFrame, grid: Grid) -> DataFrame:
    """One row that tells a profile's sources apart: totals and order-free checksums of what it was built from."""
    def checksum(df: DataFrame, *names: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*names).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))

    sources = {
        "nodes": checksum(nodes, "file_id", "node_id", "parent_id", "type", "x", "y", "z", "region_id"),
        "annotation": checksum(annotation.filter("region_id <> 0"), "ai", "bi", "ci", "region_id"),
        "structures": checksum(structures, "id", "structure_id_path"),
    }
    row = {f"{name}_{c}": frame.select(c).scalar() for name, frame in sources.items() for c in ("n", "sum")}
    row["grid"] = F.lit(f"{tuple(grid.shape)} {tuple(grid.resolution)} {grid.lr_axis} {grid.midline_um}")
    return nodes.sparkSession.range(1).select(*[v.alias(k) for k, v in row.items()])


def facts_path(path: str) -> str:
    return f"{path.rstrip('/')}_facts"


def publish_profile(nodes: DataFrame, annotation: DataFrame, structures: DataFrame, grid: Grid, path: str, mode: str = "error") -> ProfileTotals:
    """Build once, check conservation, then write the profile and, beside it, the row of facts about its sources."""
    profile = settle(build_profile(nodes, annotation, structures, grid))
    totals = source_totals(nodes)
    broken = profile_issues(profile, totals)
    if broken:
        raise ValueError(f"profile does not conserve: {broken}")
    write_profile(profile, path, mode)
    _facts(nodes, annotation, structures, grid).write.mode(mode).json(facts_path(path))
    forget(profile)
    return totals


def profile_facts(spark: SparkSession, path: str) -> DataFrame:
    """The row of facts that was written with a profile."""
    return spark.read.json(facts_path(path))


def stale_facts(nodes: DataFrame, annotation: DataFrame, structures: DataFrame, grid: Grid, path: str) -> list[str]:
    """Names of the facts in which a written profile differs from these sources; none means it may be used."""
    now = _facts(nodes, annotation, structures, grid).first().asDict()
    then = profile_facts(nodes.sparkSession, path).first().asDict()
    return sorted(k for k in now if str(now[k]) != str(then.get(k)))


def registered_profile(nodes: DataFrame, annotation: DataFrame, structures: DataFrame, grid: Grid, path: str, view: str = "region_profile") -> DataFrame:
    """A written profile under a view's name; one that was built from other sources is refused."""
    stale = stale_facts(nodes, annotation, structures, grid, path)
    if stale:
        raise ValueError(f"the profile was built from other sources: {stale}")
    profile = nodes.sparkSession.read.schema(PROFILE_SCHEMA).parquet(path)
    profile.createOrReplaceTempView(view)
    return profile
