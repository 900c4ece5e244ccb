"""Node tables: scan, morphology text ingest, writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import file_metadata, neuron_of, subject_of
from ..functions.morton import node_morton
from ..model import NODE_SCHEMA, Grid
from ..session import keep_keys, lookup_join


def scan_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Open a node table and register it as ``neurons``; a missing path raises."""
    nodes = spark.read.parquet(path)
    nodes.createOrReplaceTempView("neurons")
    return nodes


def sql_query(nodes: DataFrame, sql: str, params: Sequence | None = None) -> DataFrame:
    """User SQL over the relation ``neurons`` with positional parameters."""
    nodes.createOrReplaceTempView("neurons")
    return nodes.sparkSession.sql(sql, args=list(params) if params else None)


@dataclass(frozen=True)
class Ingested:
    """Parsed nodes, files that failed with a reason, and one row per discovered file."""

    nodes: DataFrame
    failures: DataFrame
    files: DataFrame


def read_swc_lines(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Lines of every morphology text file, with the bare file name as ``file_id``."""
    lines = (
        spark.read.option("pathGlobFilter", "*.[sS][wW][cC]").option("recursiveFileLookup", str(recursive).lower())
        .text(folder)
    )
    return lines.select(
        file_metadata("file_name").alias("file_id"), file_metadata("file_path").alias("path"), "value"
    )


def parse_swc(lines: DataFrame) -> Ingested:
    """``id type x y z radius parent`` per line; '#' comments and short lines are skipped.

    A kept line with a field that is not a number fails its file, and so does a file without any node. One file
    may hold a third of all lines: lines are parsed where they are read, and only per-file tallies are grouped.
    """
    text = F.trim(F.regexp_replace(F.split("value", "#", 2).getItem(0), r"\s+", " "))
    fields = F.split(text, " ")
    number = lambda i: F.expr(f"try_cast(try_element_at(f, {i + 1}) AS DOUBLE)")
    whole = lambda i: number(i).cast("int")
    parsed = lines.select("file_id", "path", fields.alias("f")).select(
        "file_id", "path", (F.size("f") >= 7).alias("kept"), *[F.when(F.size("f") >= 7, number(i)).alias(f"n{i}") for i in range(7)]
    )
    bad = F.lit(False)
    for i in range(7):
        bad = bad | F.col(f"n{i}").isNull()
    for i in (0, 1, 6):
        bad = bad | F.isnan(f"n{i}") | (F.abs(f"n{i}") > 2147483647)
    parsed = parsed.withColumn("bad", F.col("kept") & bad)
    # one pass over the text gives the tallies and the places of every file
    files = parsed.groupBy("file_id").agg(
        F.size(F.collect_set("path")).cast("long").alias("paths"), F.count_if("bad").alias("bad"), F.count_if("kept").alias("rows"))
    parsed = parsed.filter("kept")
    reason = F.when(F.coalesce(F.col("rows"), F.lit(0)) == 0, "no valid nodes").when(F.col("bad") > 0, "field is not a number")
    files = files.select("file_id", "paths", "rows", reason.alias("reason"))
    failures = files.filter(F.col("reason").isNotNull()).select("file_id", "reason")
    good = lookup_join(parsed, failures.select("file_id"), "file_id", "left_anti", salt_by=["n0"], check=False)
    integer = lambda name: F.col(name).cast("int")
    nodes = good.select(
        "file_id", integer("n0").alias("node_id"), integer("n1").alias("type"), F.col("n2").alias("x"),
        F.col("n3").alias("y"), F.col("n4").alias("z"), F.col("n5").alias("radius"), integer("n6").alias("parent_id"),
        F.lit(None).cast("int").alias("region_id"), F.lit(None).cast("string").alias("region_name"),
        F.lit(None).cast("string").alias("region_acronym"), subject_of("file_id").alias("subject"),
        neuron_of("file_id").alias("neuron_id"),
    )
    return Ingested(nodes, failures, files)


def ingest_swc(spark: SparkSession, folder: str, recursive: bool = True) -> Ingested:
    return parse_swc(read_swc_lines(spark, folder, recursive))


def ingest_summary(ingested: Ingested, sides: DataFrame | None = None) -> DataFrame:
    """One row of totals. ``sides`` is the per-file outcome of the hemisphere alignment, if it ran."""
    files = ingested.files
    if sides is not None:
        files = files.join(sides.select("file_id", "outcome"), "file_id", "left")
    else:
        files = files.withColumn("outcome", F.lit(None).cast("string"))
    failed = F.col("reason").isNotNull() | F.coalesce(F.col("outcome") == "no soma", F.lit(False))
    return files.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"),
        F.count_if(~failed & (F.col("outcome") == "flipped")).alias("flipped"),
        F.count_if(~failed & (F.col("outcome") == "already target")).alias("already_target"),
        F.count_if(~failed & (F.col("outcome") == "midline")).alias("midline"),
        F.coalesce(F.sum(F.when(~failed, F.col("rows"))), F.lit(0)).alias("rows_written"),
        F.count_if(F.col("paths") > 1).alias("duplicate_names"),
    )


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """The stored column order and types; missing optional columns become null."""
    return nodes.select(*[
        (F.col(f.name) if f.name in nodes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA
    ])


def write_nodes(nodes: DataFrame, path: str, mode: str = "error") -> None:
    """Snappy Parquet, each output file sorted by (file_id, node_id) so that row groups can be skipped.

    Rows are ranged on (file_id, node_id), so one huge file is split over several tasks.
    """
    ready = canonical_nodes(nodes).repartitionByRange("file_id", "node_id").sortWithinPartitions("file_id", "node_id")
    ready.write.mode(mode).option("compression", "snappy").parquet(path)


def write_spatial_nodes(nodes: DataFrame, path: str, grid: Grid, mode: str = "error") -> None:
    """The node table in the order of a space-filling curve over the grid's voxels, with the voxel's number as ``voxel_order``.

    A row group covers a compact part of the volume, so masks and radii skip most of them; within a voxel rows lie by file.
    """
    ready = canonical_nodes(nodes).withColumn("voxel_order", node_morton(grid))
    order = ["voxel_order", "file_id", "node_id"]
    ready.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("compression", "snappy").parquet(path)


def new_files_only(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return keep_keys(incoming, existing.select("file_id"), keep=False)


def append_nodes(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Add only files whose name is not yet a ``file_id``."""
    write_nodes(new_files_only(spark.read.parquet(path), canonical_nodes(incoming)), path, mode="append")


def swc_lines(nodes: DataFrame) -> DataFrame:
    """One text line per node, three decimals."""
    return nodes.select("file_id", "node_id", F.format_string(
        "%d %d %.3f %.3f %.3f %.3f %d", "node_id", "type", "x", "y", "z", "radius", "parent_id").alias("value"))


def write_swc(nodes: DataFrame, folder: str, mode: str = "append") -> None:
    """One text file per neuron, named by its ``file_id``, as ``ingest_swc`` reads them.

    A task writes the lines of a neuron in order of node id; the finished files are moved to their names only when all are
    written. Names that exist are replaced; with ``mode="error"`` the folder must be new.
    """
    spark = nodes.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(folder)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "error" and store.exists(target):
        raise FileExistsError(folder)
    staging = f"{folder}/_staging-{uuid.uuid4().hex}"
    lines = swc_lines(nodes).repartition("file_id").sortWithinPartitions("file_id", "node_id")
    lines.select("file_id", "value").write.partitionBy("file_id").text(staging)
    for neuron in store.listStatus(path(staging)):
        name = neuron.getPath().getName()
        if not name.startswith("file_id="):
            continue
        (part,) = (f.getPath() for f in store.listStatus(neuron.getPath()) if f.getPath().getName().startswith("part-"))
        final = path(target, unquote(name.removeprefix("file_id=")))
        store.delete(final, False)
        store.rename(part, final)
    store.delete(path(staging), True)
