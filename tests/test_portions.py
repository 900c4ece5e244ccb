"""Edges folded as arrays give what the column expressions of split_edges give."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from arborlake.model import SOMA, Grid
from arborlake.operators import portions as O, profile as P

NODES = "file_id string, node_id int, parent_id int, type int, x double, y double, z double, region_id int"
GRIDS = [Grid.cubic((16, 10, 12), 25.0, 150.0), Grid((3, 40, 5), (130.0, 7.5, 60.1), 20.0, 0)]


def volume(spark, grid):
    cells = [(a, b, c, (a + 2 * b + c) % 4) for a, b, c in itertools.product(*map(range, grid.shape)) if (a + b + c) % 7]
    return spark.createDataFrame(cells, "ai int, bi int, ci int, region_id int")


def forest(odd):
    """Long zigzag edges, ends on voxel planes and on the midline, edges of no length; with ``odd`` what tables should not hold."""
    rng, rows = random.Random(4), []
    place = lambda m: rng.choice([rng.uniform(-40, m + 40), 25.0 * rng.randrange(0, int(m / 25) + 1), 150.0])
    for f in ("a", "b", "c"):
        for k in range(1, 90):
            number, parent = (k + 70_000 if k > 40 else k), rng.randrange(1, max(k, 2))
            rows.append([f, number, -1 if k == 1 else parent, 1 if k == 1 else rng.randrange(1, 5), place(400), place(250), place(300), rng.choice([0, 11, 12])])
            if k % 11 == 0:
                rows[-1][4:7] = rows[-3][4:7]
    if odd:
        for row in rng.sample(rows, 60):
            row[rng.choice([1, 2, 3, 7])] = rng.choice([None, 5, 70_050, -3])
            row[rng.choice([4, 5, 6])] = rng.choice([None, 1e9, -1e12, math.inf, -math.inf, math.nan])
        rows += [[None, 1, -1, 1, 1.0, 2.0, 3.0, 11], [None, 2, 1, 2, 90.0, 2.0, 3.0, 11], ["d", None, 1, None, None, None, None, None]] + [list(r) for r in rows[:20]]
    return [tuple(r) for r in rows]


def expected(nodes, cells, grid):
    """Node by node and portion by portion: a join, the portions as rows, another join and one sum."""
    parent = nodes.select("file_id", "node_id", F.col("type").alias("own_type"), F.col("region_id").alias("own_region"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    child = nodes.filter("parent_id <> -1").select("file_id", F.col("parent_id").alias("node_id"), "type", *[F.col(c).alias(f"{c}1") for c in "xyz"])
    met = P._portions(parent.join(child, ["file_id", "node_id"], "left"), grid).select("*", F.inline_outer("_p"))
    place, end = P._portion_place(grid), F.col("type").isNull()
    rows = met.select(
        "file_id", F.when(~end, place["voxel"]).alias("voxel"), "own_region", end.alias("end"), F.when(end, P.node_side(grid, "2")).otherwise(place["side"]).alias("side"),
        P._compartment(F.when(end, F.col("own_type")).otherwise(F.col("type"))).alias("compartment"),
        F.coalesce((F.col("t1") - F.col("t0")) * F.col("_length"), F.lit(0.0)).alias("cable"), F.when(end & (F.col("own_type") != SOMA), 1).otherwise(0).alias("termini"))
    at = cells.filter("region_id <> 0").select(grid.linear().alias("voxel"), F.col("region_id").alias("found"))
    joined = rows.filter("end OR cable > 0").join(at, "voxel", "left")
    region = F.when(F.col("end"), F.col("own_region")).otherwise(F.coalesce("found", F.lit(0)))
    return joined.groupBy("file_id", region.alias("region_id"), "side", "compartment").agg(F.sum("cable").alias("cable"), F.sum("termini").alias("termini"))


def read(rows):
    tidy = lambda v: "nan" if math.isnan(v) else v if math.isinf(v) else float(f"{v:.9g}")
    return sorted(((r["file_id"], r["region_id"], r["side"], r["compartment"], tidy(r["cable"]), r["termini"]) for r in rows.collect()), key=str)


@pytest.mark.parametrize("grid", GRIDS)
@pytest.mark.parametrize("odd", [False, True])
def test_folded_portions_are_those_of_the_expressions(spark, monkeypatch, grid, odd):
    nodes, cells = spark.createDataFrame(forest(odd), NODES).repartition(3), volume(spark, grid)
    want = read(expected(nodes, cells, grid))
    assert len(want) > 20 and read(P.tree_rows(nodes, cells, grid)) == want
    monkeypatch.setattr(O, "CELLS", 300)
    monkeypatch.setattr(O, "PLAIN_SUMS", 5)
    monkeypatch.setattr(O, "DENSE_VOXELS", 5)
    assert read(P.tree_rows(nodes, cells, grid)) == want
    monkeypatch.setattr(P.joins, "fits_broadcast", lambda *a, **k: False)
    assert read(P.tree_rows(nodes, cells, grid)) == want


def test_a_portion_is_no_row(spark):
    rows = P.tree_rows(spark.createDataFrame(forest(False), NODES), volume(spark, GRIDS[0]), GRIDS[0])
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "t0#" not in text and "Window" not in text


def test_voxels_that_repeat_count_once_per_row(spark):
    nodes, cells = spark.createDataFrame(forest(False), NODES), volume(spark, GRIDS[0])
    one = spark.createDataFrame([(4, 4, 4, 9)], "ai int, bi int, ci int, region_id int")
    assert read(P.tree_rows(nodes, cells.unionByName(one), GRIDS[0])) == read(expected(nodes, cells.unionByName(one), GRIDS[0]))
