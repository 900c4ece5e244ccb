"""Pearson correlation of voxel-count vectors, from sparse counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranks import number_rows
from ..session import settle
from .pairs import pair_products, symmetric_pairs

# How an undefined or disjoint pair is treated: corrected drops neurons without variance, legacy gives -1 to
# pairs without overlap or variance, flatmap gives 0 to neurons without variance.
POLICIES = ("corrected", "legacy", "flatmap")


def neuron_stats(counts: DataFrame) -> DataFrame:
    """Per file Σc and Σc²."""
    c = F.col("c").cast("double")
    return counts.groupBy("file_id").agg(F.sum(c).alias("sx"), F.sum(c * c).alias("sxx"))


def neuron_numbers(stats: DataFrame) -> DataFrame:
    """Files numbered from 1 in order; needed for exports only, pairs are ordered by the id itself."""
    return number_rows(stats.select("file_id"), ["file_id"], "swc_num", start=1)


def vectors_of(counts: DataFrame) -> DataFrame:
    return counts.select("file_id", F.col("voxel").alias("key"), F.col("c").alias("value"))


def pair_cross_products(counts: DataFrame) -> DataFrame:
    """(i, j, sxy) for pairs that share a voxel."""
    counts = settle(counts)
    return pair_products(vectors_of(counts)).filter("sxy <> 0")


@dataclass(frozen=True)
class PearsonResult:
    """``pairs`` (i < j, r), the eligible ids, ids without variance, the size of the voxel universe and the vectors behind r.

    ``counts`` are the same vectors as they were counted, with Σc and variance.
    """

    pairs: DataFrame
    ids: DataFrame
    zero_variance: DataFrame
    voxel_count: int
    vectors: DataFrame | None = None
    counts: DataFrame | None = None

    def distances(self) -> DataFrame:
        """(i, j, distance) with 1 - r; the frame remembers its vectors, for what follows from them without the pairs."""
        out = self.pairs.select("i", "j", (1.0 - F.col("r")).alias("distance"))
        out._vectors = self.vectors
        out._counts = None if self.counts is None else (self.counts, float(self.voxel_count))
        return out

    def table(self) -> DataFrame:
        return symmetric_pairs(self.pairs, self.ids)


def standard_vectors(counts: DataFrame, stats: DataFrame, v: Column) -> DataFrame:
    """(file_id, keys, values, shift, mark, mark2): r of two files is the product of their vectors less that of their shifts.

    Files with equal counts have equal marks.
    """
    packed = vectors_of(counts).filter("file_id IS NOT NULL AND key IS NOT NULL").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("cells"))
    scale = F.sqrt(v / F.col("var"))
    return packed.join(stats, "file_id").select(
        "file_id", F.col("cells.key").alias("keys"), F.transform("cells.value", lambda c: c.cast("double") * scale).alias("values"),
        (F.col("sx") / F.sqrt("var")).alias("shift"), *[F.xxhash64(F.lit(k), "cells").alias(name) for k, name in enumerate(("mark", "mark2"))])


def count_vectors(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(file_id, keys, values, sx, var) of the files in ``stats``."""
    packed = vectors_of(counts).filter("file_id IS NOT NULL AND key IS NOT NULL").groupBy("file_id").agg(
        F.collect_list(F.struct("key", F.col("value").cast("double").alias("value"))).alias("cells"))
    return packed.join(stats, "file_id").select("file_id", F.col("cells.key").alias("keys"), F.col("cells.value").alias("values"), "sx", "var")


def pearson(counts: DataFrame, policy: str = "corrected") -> PearsonResult:
    """All-pairs r of (file_id, voxel, c) over the union of occupied voxels."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    counts = settle(counts)
    found = counts.agg(F.count_distinct("voxel").alias("v"), F.count_distinct("file_id").alias("n")).first()
    v = F.lit(float(found["v"]))
    every = settle(neuron_stats(counts).withColumn("var", v * F.col("sxx") - F.col("sx") * F.col("sx")))
    kept = (every.filter("var > 0") if policy == "corrected" else every).select("file_id", "sx", "var")
    # the join with the kept stats inside drops the counts of neurons without variance; they still count in V
    products = pair_products(vectors_of(counts), kept, found["n"], found["v"], complete=True)
    top = v * F.col("sxy") - F.col("sx_i") * F.col("sx_j")
    spread = F.sqrt(F.greatest("var_i", F.lit(0.0)) * F.greatest("var_j", F.lit(0.0)))
    if policy == "corrected":
        r = top / F.sqrt(F.col("var_i") * F.col("var_j"))
    elif policy == "legacy":
        r = F.when(F.col("sxy") == 0, -1.0).otherwise(F.coalesce(F.try_divide(top, F.nullif(spread, F.lit(0.0))), F.lit(-1.0)))
    else:
        r = F.coalesce(F.try_divide(top, F.nullif(spread, F.lit(0.0))), F.lit(0.0))
        r = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
    return PearsonResult(
        products.select("i", "j", r.alias("r")), kept.select("file_id"), every.filter("var <= 0").select("file_id"),
        int(found["v"]), *((standard_vectors(counts, kept, v), count_vectors(counts, kept)) if policy == "corrected" else ()),
    )


def ccf_pearson(counts: DataFrame, corrected: bool = True) -> DataFrame:
    return pearson(counts, "corrected" if corrected else "legacy").table()


def corr_matrix(table: DataFrame) -> DataFrame:
    """The complete square in row order, symmetric, diagonal 1; an incomplete or undefined table is an error.

    The square stays in long form, which has no width to run out of.
    """
    table = settle(table)
    bad = ~(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < F.lit(float("inf"))))
    found = table.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad")).first()
    ids = table.select("swc_id_1").unionByName(table.select(F.col("swc_id_2").alias("swc_id_1"))).distinct().count()
    cells = table.select("swc_id_1", "swc_id_2").distinct().count()
    if found["bad"] or found["rows"] != ids * ids or cells != found["rows"]:
        raise ValueError("the correlation table must be complete and finite")
    first, second = F.least("swc_id_1", "swc_id_2"), F.greatest("swc_id_1", "swc_id_2")
    means = table.groupBy(first.alias("i"), second.alias("j")).agg(F.avg("r").alias("r"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(
        F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    ))
    value = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("r"))
    return means.select(F.explode(both).alias("p"), value.alias("r")).select(
        F.col("p.i").alias("swc_id_1"), F.col("p.j").alias("swc_id_2"), "r"
    ).orderBy("swc_id_1", "swc_id_2")
