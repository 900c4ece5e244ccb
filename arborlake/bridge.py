"""The driver's tables read as morphology relations: nodes, voxels, regions, points, labels."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .model import Grid

GRID = Grid.cubic((16, 10, 12), 25.0, 150.0)

STRUCTURES = [
    (1, "root", "root", "/1/"), (5, "Isocortex", "Isocortex", "/1/5/"),
    (10, "A", "Area A", "/1/5/10/"), (20, "B", "Area B", "/1/5/20/"), (30, "C", "Area C", "/1/5/30/"),
    (40, "CP", "Caudoputamen", "/1/40/"),
    (11, "A1", "Area A, layer 1", "/1/5/10/11/"), (12, "A2/3", "Area A, layer 2/3", "/1/5/10/12/"),
    (21, "B4", "Area B, layer 4", "/1/5/20/21/"), (22, "B5", "Area B, layer 5", "/1/5/20/22/"),
    (31, "C6a", "Area C, layer 6a", "/1/5/30/31/"), (32, "C6b", "Area C, layer 6b", "/1/5/30/32/"),
    (41, "CPa", "Caudoputamen a", "/1/40/41/"), (42, "CPb", "Caudoputamen b", "/1/40/42/"),
]

# Orders per numbering block: one (supplier, block) holds a bounded number of line items.
ORDER_BLOCK = 65_536


class Tables:
    """Relations over one folder of driver tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.grid = spark, sf_dir, GRID

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        """One binary tree per supplier.

        The row number within a supplier is the rank inside a bounded block of orders plus the size of the
        earlier blocks, so that a supplier with a third of all rows is not sorted by one task.
        """
        rows = self.raw("lineitem").select(
            "l_suppkey", "l_partkey", "l_orderkey", "l_quantity", "l_linenumber", "l_extendedprice", "l_discount",
            "l_tax", "l_shipdate", F.floor(F.col("l_orderkey") / F.lit(ORDER_BLOCK)).alias("_block"),
        )
        in_block = Window.partitionBy("l_suppkey", "_block").orderBy(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_shipdate",
        )
        before = Window.partitionBy("l_suppkey").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            rows.groupBy("l_suppkey", "_block").agg(F.count(F.lit(1)).alias("_n"))
            .select("l_suppkey", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        )
        n = (
            rows.withColumn("_rank", F.row_number().over(in_block))
            .join(offsets, ["l_suppkey", "_block"])
            .withColumn("rn", (F.col("_rank") + F.col("_before")).cast("int"))
        )
        part, order, supp = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
        b = n.select(
            F.concat(F.lit("n"), F.lpad(supp.cast("string"), 5, "0"), F.lit(".swc")).alias("file_id"),
            F.col("rn").alias("node_id"),
            F.when(F.col("rn") == 1, 1).when(supp % 5 == 0, 2).otherwise((2 + part % 3).cast("int")).alias("type"),
            ((part * 7 % 400).cast("double") + 0.5).alias("x"),
            (F.col("l_quantity") * 5 - 2.5).alias("y"),
            ((order % 300).cast("double") + 0.25).alias("z"),
            F.lit(1.0).alias("radius"),
            F.when(F.col("rn") == 1, -1).otherwise(F.floor(F.col("rn") / 2).cast("int")).alias("parent_id"),
            (supp % 7).cast("string").alias("subject"),
            (supp % 9).cast("string").alias("neuron_id"),
            (part % 17 != 0).alias("flatmap_shaped_valid"),
            (order % 11).alias("dk"),
        )
        ai, bi = F.floor(F.col("x") / 25), F.floor(F.col("y") / 25)
        return b.select(
            "file_id", "node_id", "type", "x", "y", "z", "radius", "parent_id", "subject", "neuron_id",
            F.when((ai == 15) & (bi == 9), 0)
            .otherwise((10 * (1 + F.floor(F.col("x") / 100)) + 1 + F.floor(F.col("y") / 125)).cast("int"))
            .alias("region_id"),
            (F.col("x") * 0.01).alias("x_flat_shaped"), (F.col("y") * 0.01).alias("y_flat_shaped"),
            "flatmap_shaped_valid",
            F.when(F.col("dk") == 0, -1.0).otherwise(F.col("z") * 3).alias("depth_um"),
            (F.col("dk") != 0).alias("depth_valid"),
        )

    @cached_property
    def structures(self) -> DataFrame:
        return self.spark.createDataFrame(STRUCTURES, "id int, acronym string, name string, structure_id_path string")

    @cached_property
    def named_nodes(self) -> DataFrame:
        """Nodes with the acronym and name of their region.

        The ontology is a literal of a few rows whose size Spark does not know, so it is broadcast by name: joined by region, all
        nodes of a region would be sorted in one task.
        """
        names = self.structures.select(
            F.col("id").alias("region_id"), F.col("acronym").alias("region_acronym"), F.col("name").alias("region_name")
        )
        return self.nodes.join(F.broadcast(names), "region_id", "left")

    @cached_property
    def annotation(self) -> DataFrame:
        """Sparse voxel labels. Each axis has at most 16 distinct indices, gathered in one pass."""
        part = F.col("l_partkey")
        axes = self.raw("lineitem").agg(
            *[F.collect_set((part % n).cast("int")).alias(name) for name, n in (("a", 16), ("b", 10), ("c", 12))]
        )
        cells = (
            axes.select(F.explode("a").alias("ai"), "b", "c")
            .select("ai", F.explode("b").alias("bi"), "c")
            .select("ai", "bi", F.explode("c").alias("ci"))
        )
        region = F.when((F.col("ai") == 15) & (F.col("bi") == 9), 0).otherwise(
            (10 * (1 + F.floor(F.col("ai") / 4.0)) + 1 + F.floor(F.col("bi") / 5.0)).cast("int")
        )
        return cells.withColumn("region_id", region)

    @cached_property
    def lookup(self) -> DataFrame:
        gap = (F.col("ai") + F.col("bi") + F.col("ci")) % 13 == 0
        return self.annotation.select(
            "ai", "bi", "ci",
            F.when(gap, -1.0).otherwise(F.col("ai") * 0.25).alias("x_flat"),
            F.when(gap, -1.0).otherwise(F.col("bi") * 0.25).alias("y_flat"),
            F.when(F.col("ci") % 5 == 0, -1.0).otherwise(F.col("ci") * 75.0).alias("depth_um"),
        )

    @cached_property
    def mask(self) -> DataFrame:
        return self.annotation.filter(
            F.col("ai").between(4, 9) & F.col("bi").between(2, 6) & F.col("ci").between(3, 8)
        ).select("ai", "bi", "ci")

    @cached_property
    def points(self) -> DataFrame:
        event, user, none = F.col("event_id"), F.col("user_id"), F.lit(None).cast("string")
        return self.raw("events").select(
            F.col("event_type").alias("label"), ((event * 7 % 300).cast("double") + 0.5).alias("x"),
            (user % 250).cast("double").alias("y"), (event % 400).cast("double").alias("z"),
            none.alias("region_name"), none.alias("acronym"),
            F.when(event % 3 == 0, F.lit(None)).otherwise(F.lit(11)).cast("int").alias("id"),
            F.when(event % 4 == 0, "left").alias("hemisphere"),
            F.when(user % 5 == 0, "").otherwise(F.concat(F.lit("f"), (user % 5).cast("string"), F.lit(".csv")))
            .alias("origin_csv"),
        )

    def _file_id(self, key: str):
        return F.concat(F.lit("n"), F.lpad(F.col(key).cast("string"), 5, "0"), F.lit(".swc"))

    @cached_property
    def annotations(self) -> DataFrame:
        rest = F.col("s_suppkey") % 4
        return self.raw("supplier").select(
            self._file_id("s_suppkey").alias("file_id"), F.col("s_nationkey").cast("string").alias("label"),
            F.when(rest == 0, "[]").when(rest == 1, '["a"]').when(rest == 2, '["a","b"]').otherwise('["b"]').alias("tags"),
        )

    @cached_property
    def assignments(self) -> DataFrame:
        rows = self.raw("supplier")
        first = rows.select(
            F.lit("A").alias("assignment_id"), self._file_id("s_suppkey").alias("file_id"),
            (1 + F.col("s_suppkey") % 3).cast("int").alias("label"),
        )
        second = rows.filter("s_suppkey % 7 <> 0").select(
            F.lit("B").alias("assignment_id"), self._file_id("s_suppkey").alias("file_id"),
            (1 + F.col("s_suppkey") % 4).cast("int").alias("label"),
        )
        return first.unionByName(second)
