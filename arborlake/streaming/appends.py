"""Arriving files: morphology text and point tables as file streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.nodes import canonical_nodes, new_files_only, parse_swc, write_nodes
from ..sources.points import FILE, read_point_files, row_faults, validate_points, with_origin
from ..functions import file_metadata
from ..model import NODE_SCHEMA
from ..session import forget, settle


def stream_append_swc(
    spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int | None = None, once: bool = True,
) -> StreamingQuery:
    """Append the neurons of new files to a node table.

    A file is read whole in one batch. The checkpoint remembers seen files, and the anti join on file_id keeps a
    batch that is replayed after a lost driver from being added twice. The ids of the table are read once, when the stream
    starts, and kept beside the checkpoint; each batch adds its own, so no batch reads the node table.
    """
    reader = spark.readStream.format("text").schema("value string").option("pathGlobFilter", "*.[sS][wW][cC]").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(folder).select(file_metadata("file_name").alias("file_id"), file_metadata("file_path").alias("path"), "value")
    known = f"{checkpoint.rstrip('/')}-known"
    _table_or_empty(spark, table).select("file_id").distinct().write.mode("overwrite").parquet(known)

    def add(batch: DataFrame, _epoch: int) -> None:
        session = batch.sparkSession
        incoming = canonical_nodes(parse_swc(batch).nodes)
        fresh = settle(new_files_only(session.read.parquet(known), incoming))
        write_nodes(fresh, table, mode="append")
        fresh.select("file_id").distinct().write.mode("append").parquet(known)
        forget(fresh)

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _table_or_empty(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else spark.createDataFrame([], NODE_SCHEMA)


def stream_append_points(
    spark: SparkSession, folder: str, table: str, checkpoint: str, mapping: Mapping[str, str] | None = None,
    files_per_batch: int | None = None, once: bool = True,
) -> StreamingQuery:
    """Append the points of new CSV files; each file is read under its own header and is the origin of its rows.

    A batch replaces its own part of the table, so rows arrive once even if it is repeated. Files without a known header
    and rows that break a rule of the point tables go to the folder ``<table>_rejected``, with the reason.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def put(rows: DataFrame, epoch: int, kind: str, path: str) -> None:
        writer = rows.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("_epoch").format(kind).save(path)

    def add(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        paths = [r["path"] for r in batch.select("path").distinct().collect()]
        if not paths:
            return
        points, refused = read_point_files(session, paths, mapping)
        bad = refused.select(F.col("path").alias("file"), "reason", F.lit(None).cast("string").alias("row"))
        if points is not None:
            marked = points.withColumn("_faults", row_faults(points))
            ready = validate_points(marked.filter(F.size("_faults") == 0).drop("_faults"), check=False)
            put(with_origin(ready, F.col(FILE)).drop(FILE), epoch, "parquet", table)
            rows = marked.filter(F.size("_faults") > 0)
            bad = bad.unionByName(rows.select(F.col(FILE).alias("file"), F.concat_ws(",", "_faults").alias("reason"), F.to_json(F.struct(*[f"`{c}`" for c in points.columns])).alias("row")))
        put(bad, epoch, "json", f"{table}_rejected")

    writer = reader.load(folder).select("path").writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def streamed_points(spark: SparkSession, table: str) -> DataFrame:
    """The table written by the point stream, without its batch number."""
    return spark.read.option("mergeSchema", "true").parquet(table).drop("_epoch")


