"""Pearson, search, clustering and comparison against brute force on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.model import Grid
from arborlake.operators import clustering as K, compare as A, pairs as PP, pearson as P, volumes as V
from arborlake.operators.components import connected_components
from arborlake.plans import search as S

VECTORS = [[3, 1, 0, 0, 0, 0], [6, 2, 0, 0, 0, 0], [0, 0, 1, 3, 0, 0], [1, 0, 1, 0, 2, 0]]


def nodes_of(spark, vectors):
    """Nodes in voxels along x; every file has the same display name."""
    rows = [(f"f{i}", "shared", "s", k, 2, (v + 0.25) * 25, 6.25, 6.25) for i, vec in enumerate(vectors) for v, n in enumerate(vec) for k in range(n)]
    return spark.createDataFrame(rows, "file_id string, neuron_id string, subject string, node_id int, type int, x double, y double, z double")


def square(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


@pytest.mark.parametrize("block,strip", [(512, 4096), (2, 2), (1, 1)])
def test_pearson_matches_numpy_in_any_tiling(spark, monkeypatch, block, strip):
    monkeypatch.setattr(PP.pair_products, "__defaults__", (None, None, None, False, block, strip))
    counts = V.voxel_counts(nodes_of(spark, VECTORS), 25.0)
    used = [v for v in range(6) if any(vec[v] for vec in VECTORS)]
    expected = np.corrcoef(np.array(VECTORS)[:, used])
    got = square(P.ccf_pearson(counts))
    assert len(got) == 16
    for i, j in itertools.product(range(4), repeat=2):
        assert got[f"f{i}", f"f{j}"] == pytest.approx(expected[i, j], abs=1e-12)


def test_zero_variance_policies(spark):
    vectors = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [2, 2, 2]]
    counts = V.voxel_counts(nodes_of(spark, vectors), 25.0)
    found = P.pearson(counts)
    assert [r[0] for r in found.zero_variance.collect()] == ["f3"] and found.ids.count() == 3 and found.voxel_count == 3
    legacy = square(P.ccf_pearson(counts, corrected=False))
    assert len(legacy) == 16 and legacy["f0", "f1"] == -1.0 and legacy["f0", "f3"] == -1.0 and legacy["f3", "f3"] == 1.0
    flat = square(P.pearson(counts, "flatmap").table())
    assert flat["f0", "f3"] == 0.0 and flat["f0", "f1"] == pytest.approx(-0.5)
    with pytest.raises(ValueError, match="complete"):
        P.corr_matrix(P.ccf_pearson(counts).filter("swc_id_1 <> 'f0' OR swc_id_2 <> 'f1'"))
    square_rows = P.corr_matrix(P.ccf_pearson(counts)).collect()
    assert [r["swc_id_1"] for r in square_rows] == ["f0"] * 3 + ["f1"] * 3 + ["f2"] * 3 and square_rows[0]["r"] == 1.0


def test_one_voxel_holds_most_rows(spark):
    vectors = [[50, i % 3, (i * 7) % 5, 0] for i in range(30)]
    counts = V.voxel_counts(nodes_of(spark, vectors), 25.0)
    expected = np.corrcoef(np.array(vectors)[:, :3])
    got = square(P.ccf_pearson(counts))
    for i, j in itertools.combinations(range(30), 2):
        assert got[f"f{i}", f"f{j}"] == pytest.approx(expected[i, j], abs=1e-9)


def test_search_ranks_like_the_aggregate_vector(spark):
    nodes = nodes_of(spark, VECTORS)
    hits = S.voxel_search(nodes, S.VoxelSearch(("f0", "f2"), top_n=5)).collect()
    query = np.array(VECTORS[0]) + np.array(VECTORS[2])
    used = [0, 1, 2, 3, 4]
    expected = {f"f{i}": 1 - np.corrcoef(query[used], np.array(VECTORS[i])[used])[0, 1] for i in (1, 3)}
    assert [r["rank"] for r in hits] == [1, 2] and [r["file_id"] for r in hits] == sorted(expected, key=expected.get)
    assert all(r["pearson_distance"] == pytest.approx(expected[r["file_id"]]) for r in hits)
    with pytest.raises(ValueError, match="not in the table"):
        S.voxel_search(nodes, S.VoxelSearch(("nobody",)))
    with pytest.raises(ValueError, match="no candidate"):
        S.voxel_search(nodes, S.VoxelSearch(("f0",), candidates=("f0",)))
    with pytest.raises(Exception, match="constant"):
        S.voxel_search(nodes_of(spark, [[2, 2], [3, 1]]), S.VoxelSearch(("f0",))).collect()


RNG = np.random.default_rng(7)
POINTS = RNG.normal(size=(80, 3)) * 100


def coords(spark, points):
    return spark.createDataFrame([(f"p{i:04d}", *map(float, p)) for i, p in enumerate(points)], "file_id string, x double, y double, z double")


def brute_tree(points, method):
    """Merge heights and, per pair, the height that joins it."""
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    groups, heights, joined = [[i] for i in range(len(points))], [], np.zeros_like(d)

    def gap(a, b):
        sub = d[np.ix_(a, b)]
        if method == "ward":
            return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(points[a].mean(0) - points[b].mean(0))
        return {"single": sub.min(), "complete": sub.max(), "average": sub.mean()}[method]

    while len(groups) > 1:
        h, i, j = min((gap(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        joined[np.ix_(groups[i], groups[j])] = joined[np.ix_(groups[j], groups[i])] = h
        heights.append(h)
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return np.sort(heights), joined


def partition(rows, n):
    out = {}
    for name, label in rows:
        out.setdefault(label, set()).add(name)
    assert len(out) == n
    return {frozenset(v) for v in out.values()}


@pytest.fixture(scope="module")
def trees(spark):
    rows = coords(spark, POINTS)
    pairs = K.soma_distances(rows)
    return {m: K.hierarchical(pairs, rows.select("file_id"), m) for m in K.LINKAGES}


@pytest.mark.parametrize("method", K.LINKAGES)
def test_trees_match_one_merge_at_a_time(trees, method):
    heights, joined = brute_tree(POINTS, method)
    tree = trees[method]
    assert np.allclose(sorted(r[0] for r in tree.merges.select("height").collect()), heights)
    for r in K.cophenetic(tree).collect():
        assert r["height"] == pytest.approx(joined[int(r["i"][1:]), int(r["j"][1:])])
    positions = [r["position"] for r in tree.leaf_order.orderBy("position").collect()]
    assert positions == list(range(len(POINTS)))


def test_cuts(trees):
    _, joined = brute_tree(POINTS, "average")
    heights = np.sort(np.unique(joined[joined > 0]))[::-1]
    for k in (1, 2, 5, 9):
        got = partition([tuple(r) for r in K.cut_clusters(trees["average"], k).select("file_id", "label").collect()], k)
        limit = heights[k - 1]
        expected = {frozenset(f"p{j:04d}" for j in range(len(POINTS)) if i == j or joined[i, j] <= limit) for i in range(len(POINTS))}
        assert got == expected
        assert partition([tuple(r) for r in K.cut_clusters(trees["average"], k, exact=True).select("file_id", "label").collect()], k) == expected
    first = K.cut_clusters(trees["average"], 4).groupBy("label").agg(F.min("file_id").alias("m")).orderBy("label").collect()
    assert [r["m"] for r in first] == sorted(r["m"] for r in first)


def test_equal_heights_merge_together(spark):
    rows = coords(spark, [(0, 0, 0), (1, 0, 0), (10, 0, 0), (11, 0, 0), (100, 0, 0)])
    tree = K.hierarchical(K.soma_distances(rows), rows.select("file_id"), "single")
    assert K.cut_clusters(tree, 4).select("label").distinct().count() == 3
    assert K.cut_clusters(tree, 4, exact=True).select("label").distinct().count() == 4


def test_blocks_of_the_leaf_order(spark, monkeypatch, trees):
    whole = {(r["i"], r["j"]): r["height"] for r in K.cophenetic(trees["average"]).collect()}
    monkeypatch.setattr(K, "BLOCK", 16)
    parts = {(r["i"], r["j"]): r["height"] for r in K.cophenetic(trees["average"]).collect()}
    assert parts == whole


def ranks(v):
    order = np.argsort(v, kind="mergesort")
    out = np.empty(len(v))
    for value in np.unique(v):
        out[v == value] = 0
    sorted_v = v[order]
    for value in np.unique(v):
        places = np.flatnonzero(sorted_v == value) + 1
        out[v == value] = places.mean()
    return out


def test_spearman_and_partition_scores(trees):
    a, b = brute_tree(POINTS, "average")[1], brute_tree(POINTS, "complete")[1]
    upper = np.triu_indices(len(POINTS), 1)
    expected = np.corrcoef(ranks(np.round(a[upper], 9)), ranks(np.round(b[upper], 9)))[0, 1]
    assert K.cophenetic_spearman(trees["average"], trees["complete"]).first()["spearman"] == pytest.approx(expected, abs=1e-6)
    same = A.compare_partitions(trees["average"], trees["average"]).collect()
    assert len(same) == 19 and all(r["ari"] == 1.0 and r["nmi"] == pytest.approx(1.0) for r in same)


def brute_dbscan(points, eps, m):
    d = np.linalg.norm(points[:, None] - points[None], axis=2) <= eps
    core = d.sum(1) >= m
    label, number = np.ones(len(points), int), 1
    for i in range(len(points)):
        if core[i] and label[i] == 1:
            number += 1
            stack = [i]
            label[i] = number
            while stack:
                k = stack.pop()
                for j in np.flatnonzero(d[k] & core & (label == 1)):
                    label[j] = number
                    stack.append(j)
    final = label.copy()
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        final[i] = near.min() if len(near) else 1
    return final


@pytest.mark.parametrize("kind", ["normal", "crowded", "chain"])
def test_dbscan(spark, kind):
    rng = np.random.default_rng(5)
    points = {
        "normal": rng.normal(size=(150, 3)) * 60,
        "crowded": np.vstack([rng.normal(size=(120, 3)) * 4, rng.normal(size=(60, 3)) * 4 + [58, 0, 0], rng.uniform(-200, 200, size=(40, 3))]),
        "chain": np.column_stack([np.arange(60) * 9.0, np.zeros(60), np.zeros(60)]),
    }[kind]
    for eps, m in ((30.0, 4), (45.0, 8)):
        got = {r["file_id"]: r["label"] for r in K.soma_dbscan(coords(spark, points), eps, m).collect()}
        assert [got[f"p{i:04d}"] for i in range(len(points))] == list(brute_dbscan(points, eps, m))


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(20, 3)) + c for c in ([0, 0, 0], [50, 0, 0], [0, 50, 0])])
    got = partition([tuple(r) for r in K.soma_kmeans(coords(spark, points), 3, starts=2).collect()], 3)
    assert got == {frozenset(f"p{i:04d}" for i in range(a, a + 20)) for a in (0, 20, 40)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)]
    ids = sorted({v for e in chain for v in e} | {500})
    found = connected_components(spark.createDataFrame([(i,) for i in ids], "id int"), spark.createDataFrame(chain, "src int, dst int"))
    got = {r["id"]: r["component"] for r in found.collect()}
    assert all(got[i] == (0 if i <= 60 else 100 if i < 200 else 500) for i in ids)


def test_label_agreement(spark):
    a, b = [1, 1, 1, 2, 2, 3, 3, 3], [5, 5, 6, 6, 6, 7, 7, 5]
    table = lambda v: spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(v)], "file_id string, label int")
    row = A.compare_memberships(table(a), table(b), table(a + [0]), table(b)).first()
    n = len(a)
    pairs = list(itertools.combinations(range(n), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    pa, pb = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    expected = (both - pa * pb / len(pairs)) / ((pa + pb) / 2 - pa * pb / len(pairs))
    assert row["ari"] == pytest.approx(expected) and row["reference_cohort_only"] == 1 and row["assigned_in_both"] == 8
    h = lambda v: -sum(v.count(x) / n * math.log(v.count(x) / n) for x in set(v))
    joint = list(zip(a, b))
    mutual = h(a) + h(b) - h(joint)
    assert row["nmi"] == pytest.approx(mutual / ((h(a) + h(b)) / 2)) and row["mutual_agreement"] == pytest.approx(6 / 8)
    none = A.compare_memberships(table(a), table(b).filter("label > 99"), table(a), table(b)).first()
    assert none["status"] == "no_joint_assignments" and none["ari"] is None


def test_empty_sets_have_no_fractions(spark):
    empty = spark.createDataFrame([], "file_id string")
    row = A.membership_overlap(empty, empty).first()
    assert row["a"] == 0 and row["jaccard"] is None and row["dice"] is None


def test_grid_edges():
    with pytest.raises(ValueError):
        S.VoxelSearch(())
    assert Grid.cubic((528, 320, 456), 25.0).mirror_point == 5687.5 and Grid.cubic((528, 320, 456), 25.0).midline_um == 5700.0


def test_the_last_merges_do_not_depend_on_where_they_are_made(spark):
    import random

    rng = random.Random(3)
    for method, place in (("average", rng.random), ("ward", rng.random), ("single", lambda: float(rng.randrange(6)))):
        rows = spark.createDataFrame([(f"f{k:02d}", place(), place(), 0.0) for k in range(12)], "file_id string, x double, y double, z double")
        pairs, ids = K.soma_distances(rows), rows.select("file_id")
        trees = [K.hierarchical(pairs, ids, method, last=last) for last in (64, 1)]
        one, two = (sorted((round(r["height"], 9), r["size"], r["left_id"], r["right_id"]) for r in t.merges.collect()) for t in trees)
        assert one == two
        one, two = (sorted(map(tuple, K.cut_clusters(t, 5, exact=True).collect())) for t in trees)
        assert one == two
