"""Quantiles, the space-filling layout, the bitmap index and the resident linkage matrix."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import quantiles as Q
from arborlake.functions.morton import in_ranges, morton, node_morton, ranges_of
from arborlake.model import Grid
from arborlake.operators import clustering as K, linkage as L
from arborlake.operators.filters import voxel_mask_filter
from arborlake.plans import region_index as I, region_query as RQ
from arborlake.plans.mask_query import neurons_in_masks
from arborlake.plans.region_query import AllOf, AnyOf, NeuriteIn, Not, Regions, SomaIn, Threshold
from arborlake.sources.nodes import write_spatial_nodes


# --- quantiles

@pytest.mark.parametrize("kind", ["uniform", "ties", "two", "heavy tail", "one"])
def test_order_statistics(spark, monkeypatch, kind):
    monkeypatch.setattr(Q, "SMALL", 20)
    rng = np.random.default_rng(4)
    values = {
        "uniform": rng.random(20_000), "ties": rng.integers(0, 50, 20_000) / 7, "two": rng.integers(0, 2, 20_000) * 1.0,
        "heavy tail": np.exp(rng.normal(size=20_000) * 8) * rng.choice([-1, 1], 20_000), "one": np.array([3.0]),
    }[kind]
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
    n = len(values)
    ranks = sorted({0, n - 1, n // 2, n // 3, n // 100, min(n // 100 + 1, n - 1)})
    assert Q.order_statistics(frame, "v", ranks) == [float(v) for v in np.sort(values)[ranks]]
    assert Q.percentiles(frame, "v", [1, 50, 99], n) == pytest.approx(np.percentile(values, [1, 50, 99]))


def test_ranks_are_found_together(spark, monkeypatch):
    """The number of jobs does not grow with the number of ranks, and a sketch that misses is noticed."""
    frame = spark.range(30_000).select((F.col("id") * 7919 % 30_000).cast("double").alias("v")).cache()
    passes = []
    monkeypatch.setattr(Q, "SMALL", 5)
    real = Q._inside
    monkeypatch.setattr(Q, "_inside", lambda v, a, b: passes.append((a, b)) or real(v, a, b))
    ranks = list(range(0, 30_000, 1501))
    assert Q.order_statistics(frame, "v", ranks) == [float(r) for r in ranks]
    monkeypatch.setattr(Q, "ACCURACY", 10**9)  # brackets far too narrow for the real sketch
    monkeypatch.setattr(Q, "STEPS", 16)
    assert Q.order_statistics(frame, "v", [17, 29_999]) == [17.0, 29_999.0]


# --- space-filling order

def bits(a, b, c):
    return sum((a >> k & 1) << 3 * k + 2 | (b >> k & 1) << 3 * k + 1 | (c >> k & 1) << 3 * k for k in range(20))


def test_morton_numbers(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(1 << rng.randrange(1, 21)) for _ in range(3)) for _ in range(200)] + [(-1, 0, 0), (1 << 20, 0, 0), ((1 << 20) - 1,) * 3]
    found = spark.createDataFrame(rows, "ai long, bi long, ci long").select("ai", "bi", "ci", morton(F.col("ai"), F.col("bi"), F.col("ci")).alias("m")).collect()
    for r in found:
        inside = all(0 <= v < 1 << 20 for v in r[:3])
        assert r["m"] == (bits(*r[:3]) if inside else None)


def test_ranges_hold_the_mask(spark):
    rng = random.Random(2)
    for voxels in ([(3, 3, 3)], [(a, b, c) for a in range(20, 40) for b in range(5, 30) for c in range(7)], [tuple(rng.randrange(300) for _ in range(3)) for _ in range(500)]):
        frame = spark.createDataFrame(voxels, "ai long, bi long, ci long")
        ranges = ranges_of(frame)
        assert 0 < len(ranges) <= 64 and all(any(a <= bits(*v) <= b for a, b in ranges) for v in voxels)
    assert ranges_of(frame.limit(0)) == []


def test_a_small_mask_skips_row_groups(spark, tmp_path):
    """Rows that the scan gives out, by its own metric, in a table along the curve."""
    grid = Grid((64, 64, 64), (25.0,) * 3)
    rows = spark.range(200_000).select(
        F.concat(F.lit("n"), (F.col("id") % 50).cast("string")).alias("file_id"), F.col("id").cast("int").alias("node_id"), F.lit(2).alias("type"),
        *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1600_000)) / 1000.0).alias(c) for k, c in enumerate("xyz")],
        F.lit(1.0).alias("radius"), F.lit(-1).alias("parent_id"), F.lit("s").alias("subject"), F.col("id").cast("string").alias("neuron_id"))
    spark._jsc.hadoopConfiguration().setInt("parquet.block.size", 256 << 10)
    try:
        write_spatial_nodes(rows, str(tmp_path / "nodes"), grid)
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.block.size")
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    mask = spark.createDataFrame(list(itertools.product(range(30, 34), range(30, 34), range(10, 14))), "ai long, bi long, ci long")
    found = neurons_in_masks(nodes, grid, [mask])
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, neurons_in_masks(rows, grid, [mask]).collect())) and got
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "voxel_order" in plan[plan.index("PushedFilters"):]
    ranges = ranges_of(mask)
    scan = nodes.filter(in_ranges("voxel_order", ranges)).select("file_id", "voxel_order")
    read = scan._jdf.queryExecution()
    scan_rows = scan.collect()
    leaves = read.executedPlan().collectLeaves()
    out = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert len(scan_rows) <= out < 40_000
    kept = voxel_mask_filter(nodes, grid, include=mask)
    assert kept.count() == voxel_mask_filter(rows, grid, include=mask).count() > 0
    assert "voxel_order" in kept._jdf.queryExecution().executedPlan().toString()
    off = spark.createDataFrame([("a", math.nan, 1.0, 1.0), ("b", None, 1.0, 1.0), ("c", -30.0, 1.0, 1.0)], "file_id string, x double, y double, z double")
    assert [r[0] for r in off.select(node_morton(grid)).collect()] == [None] * 3


# --- bitmap index

CLOSURE = [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2), (2, 2, 0), (2, 4, 1), (2, 5, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0)]


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(5)
    rows = []
    for k in range(150):
        for region in (0, 2, 3, 4, 5):
            for side in ("ipsilateral", "contralateral", "midline"):
                for part in ("soma", "neurite"):
                    if rng.random() < 0.25:
                        rows.append((f"f{k:03d}", region, side, part, rng.choice([0.0, 1.5, 40.0]), rng.choice([0, 1, 9]), rng.choice([0, 2])))
    profile = spark.createDataFrame(rows, "file_id string, region_id int, laterality string, compartment string, cable_length_um double, node_count long, terminus_count long")
    closure = spark.createDataFrame(CLOSURE, "ancestor_region_id int, direct_region_id int, depth int")
    return profile, closure, I.build_index(profile, closure)


TREES = [
    SomaIn(Regions((2,))), NeuriteIn(Regions((1,)), "contralateral"), Not(NeuriteIn(Regions((2, 3)))), NeuriteIn(Regions((2,), descendants=False)),
    Threshold(Regions((1, 4)), "cable_length_um", ">=", 80.0), Threshold(Regions((2,)), "node_count", "<", 3), Threshold(Regions((4,)), "terminus_count", "=", 0, "soma"),
    AllOf((AnyOf((SomaIn(Regions((4,))), NeuriteIn(Regions((3,)), "ipsilateral"))), Not(Threshold(Regions((5,)), "node_count", ">", 8)), NeuriteIn(Regions((1,))))),
    AnyOf((Not(Threshold(Regions((2,)), "cable_length_um", "<=", 1.0, laterality="midline")), AllOf((SomaIn(Regions((3,))), Not(SomaIn(Regions((5,)))))))),
]


@pytest.mark.parametrize("tree", TREES, ids=range(len(TREES)))
def test_index_gives_the_files_of_the_scan(spark, indexed, tree):
    profile, closure, index = indexed
    want = sorted(r[0] for r in RQ.matching_files(profile, closure, tree).collect())
    assert sorted(r[0] for r in I.indexed_files(index, tree).collect()) == want
    some = ["f001", "f010", "f100", "nobody"]
    assert sorted(r[0] for r in I.indexed_files(index, tree, some).collect()) == [f for f in want if f in some]


def test_index_is_written_and_counts_neurons(spark, indexed, tmp_path):
    profile, closure, index = indexed
    index.write(str(tmp_path / "index"))
    again = I.open_index(spark, str(tmp_path / "index"))
    assert sorted(r[0] for r in I.indexed_files(again, TREES[7]).collect()) == sorted(r[0] for r in I.indexed_files(index, TREES[7]).collect())
    with pytest.raises(ValueError, match="unknown regions"):
        I.indexed_files(again, SomaIn(Regions((77,))))
    rows = profile.filter("compartment = 'neurite' AND (node_count > 0 OR cable_length_um > 0)")
    for split, cohort in ((False, None), (True, ["f003", "f030", "f101", "f149"])):
        chosen = rows if cohort is None else rows.filter(F.col("file_id").isin(cohort))
        side = F.col("laterality") if split else F.lit("combined")
        own = chosen.groupBy("region_id", side.alias("laterality")).agg(F.count_distinct("file_id").alias("n")).withColumn("up", F.lit(False))
        up = chosen.join(closure, chosen["region_id"] == closure["direct_region_id"]).groupBy(F.col("ancestor_region_id").alias("region_id"), side.alias("laterality")).agg(F.count_distinct("file_id").alias("n")).withColumn("up", F.lit(True))
        want = sorted((r["region_id"], r["laterality"], r["up"], r["n"]) for r in own.unionByName(up).collect())
        assert sorted((r["region_id"], r["laterality"], r["is_aggregate"], r["neurons_present"]) for r in I.neurons_present(again, split, cohort).collect()) == want


# --- linkage

def pair_table(spark, points):
    rows = spark.createDataFrame([(f"p{i:03d}", *map(float, p)) for i, p in enumerate(points)], "file_id string, x double, y double, z double")
    return K.soma_distances(rows), rows.select("file_id")


@pytest.mark.parametrize("method", L.LINKAGES)
def test_rounds_of_jobs_make_the_merges_of_one_task(spark, method):
    rng = np.random.default_rng(6)
    pairs, ids = pair_table(spark, np.vstack([rng.normal(size=(40, 3)) * 30, np.cumsum(np.arange(12))[:, None] * np.array([[3.0, 0.0, 0.0]]) + 200]))
    trees = [K.hierarchical(pairs, ids, method, last=last) for last in (512, 9)]
    one, two = (sorted((r["left_id"], r["right_id"], round(r["height"], 9), r["size"], r["left_size"]) for r in t.merges.collect()) for t in trees)
    assert one == two and len(one) == 51


def test_few_neurons(spark):
    for n in (1, 2):
        pairs, ids = pair_table(spark, np.arange(3 * n).reshape(n, 3))
        for method in L.LINKAGES:
            tree = K.hierarchical(pairs, ids, method)
            assert tree.merges.count() == n - 1 and sorted(r["position"] for r in tree.leaf_order.collect()) == list(range(n))


def test_a_round_writes_no_matrix(spark, monkeypatch):
    """The matrix is written again only when half of its clusters are gone, however many rounds there are."""
    points = np.cumsum(1.0 + np.arange(30) / 7)[:, None] * np.array([[1.0, 0.0, 0.0]])  # growing gaps: a merge per round
    pairs, ids = pair_table(spark, points)
    sizes = []
    real = L.settle
    monkeypatch.setattr(L, "settle", lambda df, **k: sizes.append(len(df.columns)) or real(df, **k))
    tree = K.hierarchical(pairs, ids, "complete", last=2)
    assert tree.merges.count() == 29 and len(sizes) <= 6


def test_spanning_tree_takes_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    d = rng.integers(1, 40, (60, 60)).astype(float)  # with many equal lengths
    d = np.triu(d, 1) + np.triu(d, 1).T
    cells = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(60) for j in range(60) if i != j], "r long, c long, s double")
    matrix = L.matrix_rows(cells, 60)
    rounds = []
    real = L._cheapest
    monkeypatch.setattr(L, "_cheapest", lambda label: rounds.append(len(set(label.tolist()))) or real(label))
    tree = L.spanning_tree(matrix, 60)
    lead, want = list(range(60)), 0.0

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for w, i, j in sorted((d[i, j], i, j) for i, j in itertools.combinations(range(60), 2)):
        if root(i) != root(j):
            lead[root(i)] = root(j)
            want += w
    assert tree[:, 0].sum() == want and len(tree) == 59
    assert all(2 * b <= a for a, b in zip(rounds, rounds[1:]))


def test_range_maxima(spark):
    rng = random.Random(8)
    tops = [rng.random() for _ in range(13)]
    found = {(r["level"], r["block"]): r["top"] for r in K.range_maxima(spark.createDataFrame(list(enumerate(tops)), "block int, top double"), 13).collect()}
    assert found == {(k, b): max(tops[b: b + 2**k]) for k in range(4) for b in range(13 - 2**k + 1)}
