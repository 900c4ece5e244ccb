"""Trees, edge splitting, the profile and the queries on it, on hand-made neurons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arborlake.model import Grid
from arborlake.operators import profile as P, regions as R, topology as T
from arborlake.plans import region_query as Q, report as G

NODES = "file_id string, node_id int, type int, x double, y double, z double, parent_id int, region_id int"


def table(spark, rows):
    return spark.createDataFrame(rows, NODES)


def node(i, kind, parent, x=1.0, y=1.0, z=1.0, file="a", region=0):
    return (file, i, kind, float(x), float(y), float(z), parent, region)


CASES = {
    "chain": [(1, -1), (2, 1), (3, 2)], "branch": [(1, -1), (2, 1), (3, 2), (4, 2)], "gaps": [(10, -1), (20, 10), (99, 20)],
    "late parent": [(5, -1), (1, 9), (9, 5)], "single": [(7, -1)], "dangling": [(1, -1), (2, 55)],
}


@pytest.mark.parametrize("name", CASES)
def test_childless(spark, name):
    links = CASES[name]
    got = {r["node_id"] for r in T.childless(table(spark, [node(i, 2, p) for i, p in links])).collect()}
    assert got == {i for i, _ in links} - {p for _, p in links}


def test_axon_with_only_a_dendrite_child_is_no_terminus(spark):
    rows = table(spark, [node(1, 1, -1), node(2, 2, 1), node(3, 3, 2)])
    assert T.termini(rows).count() == 0
    assert [r["node_id"] for r in T.termini(rows, None).collect()] == [3]
    coverage = T.termini_coverage(rows)
    report = T.coverage_report(coverage)
    assert report["termini_found"] == 0 and report["childless_nodes_excluded"] == 1
    assert [r[0] for r in T.files_without_termini(coverage).collect()] == ["a"]


@pytest.fixture(scope="module")
def small(spark):
    """Annotation (4, 2, 4) of 10 x 20 x 30 um, region 11 in the lower half of axis 0 and 12 in the upper; midline 60."""
    cells = [(a, b, c, 11 if a < 2 else 12) for a in range(4) for b in range(2) for c in range(4)]
    return Grid((4, 2, 4), (10.0, 20.0, 30.0), 60.0), spark.createDataFrame(cells, "ai int, bi int, ci int, region_id int")


def pieces(spark, small, start, stop):
    grid, annotation = small
    edge = spark.createDataFrame([("a", 2, 1, 2, *map(float, start), *map(float, stop))],
                                 "file_id string, node_id int, parent_id int, type int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    volume = annotation.select(grid.linear().alias("voxel"), "region_id")
    rows = P.split_edges(edge, grid).join(volume, "voxel", "left").orderBy("t0").collect()
    return [(round(r["length_um"], 9), r["region_id"] or 0, r["side"]) for r in rows]


def test_four_known_segments(spark, small):
    assert pieces(spark, small, (1, 1, 1), (9, 1, 1)) == [(8.0, 11, "lower")]
    assert pieces(spark, small, (15, 1, 1), (35, 1, 1)) == [(5.0, 11, "lower"), (10.0, 12, "lower"), (5.0, 12, "lower")]
    assert pieces(spark, small, (5, 5, 45), (5, 5, 75)) == [(15.0, 11, "lower"), (15.0, 11, "upper")]
    assert pieces(spark, small, (-5, 5, 5), (15, 5, 5)) == [(5.0, 0, "lower"), (10.0, 11, "lower"), (5.0, 11, "lower")]


def test_edge_in_the_midline_plane_and_zero_edge(spark, small):
    assert pieces(spark, small, (5, 5, 60), (9, 5, 60)) == [(4.0, 11, "midline")]
    assert pieces(spark, small, (5, 5, 5), (5, 5, 5)) == []


def test_random_edges_conserve_length_and_match_sampling(spark, small):
    grid, annotation = small
    rng = random.Random(3)
    ends = [([rng.uniform(-10, 50), rng.uniform(-10, 50), rng.uniform(-20, 140)], [rng.uniform(-10, 50), rng.uniform(-10, 50), rng.uniform(-20, 140)]) for _ in range(40)]
    rows = [("a", i, 0, 2, *a, *b) for i, (a, b) in enumerate(ends)]
    edges = spark.createDataFrame(rows, "file_id string, node_id int, parent_id int, type int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    inside = {r["node_id"]: (r["all"], r["inside"]) for r in P.split_edges(edges, grid).groupBy("node_id").agg(
        F.sum("length_um").alias("all"), F.sum(F.when(F.col("voxel").isNotNull(), F.col("length_um")).otherwise(0.0)).alias("inside")).collect()}
    for i, (a, b) in enumerate(ends):
        length = math.dist(a, b)
        assert inside[i][0] == pytest.approx(length, abs=1e-9)
        steps = 4000
        hits = 0
        for k in range(steps):
            p = [u + (k + 0.5) / steps * (v - u) for u, v in zip(a, b)]
            hits += all(0 <= math.floor(c / r) < n for c, r, n in zip(p, grid.resolution, grid.shape))
        assert inside[i][1] == pytest.approx(length * hits / steps, abs=length / 500)


STRUCTURES = [(1, "root", "root", "/1/"), (10, "A", "Area A", "/1/10/"), (11, "A1", "Area A1", "/1/10/11/"),
              (12, "A2", "Area A2", "/1/10/12/"), (20, "B", "Area B", "/1/20/")]


@pytest.fixture(scope="module")
def structures(spark):
    return spark.createDataFrame(STRUCTURES, "id int, acronym string, name string, structure_id_path string")


def mirror_pair():
    """Two files with equal node ids; the second is the first seen in a mirror at z = 60. A child comes first."""
    first = [(250, 2, 100, 15.0, 5.0, 70.0), (100, 1, -1, 5.0, 5.0, 20.0), (900, 0, 250, 35.0, 25.0, 100.0)]
    rows = []
    for name, flip in (("a", False), ("b", True)):
        for i, kind, parent, x, y, z in first:
            rows.append((name, i, kind, x, y, 120.0 - z if flip else z, parent, 11 if x < 20 else 12))
    return rows


def test_mirror_images_have_equal_profiles(spark, small, structures):
    grid, annotation = small
    built = P.build_profile(table(spark, mirror_pair()), annotation, structures, grid)
    rows = lambda f: sorted((r["region_id"], r["laterality"], r["compartment"], round(r["cable_length_um"], 9), r["node_count"], r["terminus_count"])
                            for r in built.filter(F.col("file_id") == f).collect())
    assert rows("a") == rows("b") and len(rows("a")) > 2
    totals = P.source_totals(table(spark, mirror_pair()))
    assert totals.edges == 4 and totals.termini == 2 and P.profile_issues(built, totals) == []


@pytest.mark.parametrize("issue,rows", [
    ("not exactly one root", [node(1, 1, -1), node(2, 2, -1)]), ("not exactly one soma", [node(1, 2, -1)]),
    ("soma is not the root", [node(1, 2, -1), node(2, 1, 1)]), ("dangling parent_id", [node(1, 1, -1), node(2, 2, 9)]),
    ("duplicate node_id", [node(1, 1, -1), node(2, 2, 1), node(2, 2, 1)]), ("unknown region_id", [node(1, 1, -1, region=99)]),
    ("coordinate not finite", [node(1, 1, -1, x=float("nan"))]), ("negative region_id", [node(1, 1, -1, region=-4)]),
    ("not connected to the root", [node(1, 1, -1), node(2, 2, 3), node(3, 2, 4), node(4, 2, 2), node(5, 2, 4)]),
])
def test_broken_trees_are_named(spark, small, structures, issue, rows):
    grid, annotation = small
    found = {r["issue"] for r in T.validate_trees(table(spark, rows), structures).collect()}
    assert issue in found
    with pytest.raises(ValueError, match="failed validation"):
        P.build_profile(table(spark, rows), annotation, structures, grid)


def test_long_chain_is_reachable(spark):
    rows = [node(1, 1, -1)] + [node(i, 2, i - 1) for i in range(2, 300)]
    row = T.reachable_counts(table(spark, rows)).first()
    assert (row["reached"], row["total"]) == (299, 299)


PROFILE = [
    ("a", 11, "ipsilateral", "neurite", 1000.0, 5, 2), ("a", 11, "contralateral", "neurite", 500.0, 1, 0), ("a", 11, "ipsilateral", "soma", 0.0, 1, 0),
    ("a", 20, "ipsilateral", "neurite", 0.0, 0, 0), ("b", 11, "ipsilateral", "neurite", 2000.0, 8, 3), ("b", 0, "unknown", "neurite", 250.0, 2, 1),
    ("b", 12, "midline", "neurite", 10.0, 0, 0), ("b", 20, "ipsilateral", "soma", 0.0, 1, 0), ("zero", 10, "ipsilateral", "soma", 0.0, 1, 0),
]


@pytest.fixture(scope="module")
def profile(spark):
    return spark.createDataFrame(PROFILE, "file_id string, region_id int, laterality string, compartment string, cable_length_um double, node_count long, terminus_count long")


@pytest.fixture(scope="module")
def closure(structures):
    return R.structures_closure(structures)


def ids(df):
    return sorted(r[0] for r in df.select("file_id").collect())


def test_conditions_and_their_set_form(spark, profile, closure):
    A = Q.Regions((10,))
    trees = {
        "soma": (Q.SomaIn(A), ["a", "zero"]), "direct only": (Q.SomaIn(Q.Regions((10,), descendants=False)), ["zero"]),
        "neurite": (Q.NeuriteIn(A), ["a", "b"]), "contra": (Q.NeuriteIn(A, "contralateral"), ["a"]),
        "sum": (Q.Threshold(A, "cable_length_um", ">=", 1500.0), ["a", "b"]), "absent is zero": (Q.Threshold(A, "terminus_count", "<=", 0), ["zero"]),
        "not": (Q.Not(Q.NeuriteIn(A)), ["zero"]), "all": (Q.AllOf((Q.SomaIn(A), Q.NeuriteIn(A))), ["a"]),
        "any": (Q.AnyOf((Q.SomaIn(A), Q.Not(Q.NeuriteIn(Q.Regions((20,)))))), ["a", "b", "zero"]),
    }
    for name, (tree, expected) in trees.items():
        assert ids(Q.matching_files(profile, closure, tree)) == expected, name
        assert ids(Q.matching_files_by_sets(profile, closure, tree)) == expected, name
    assert ids(Q.matching_files(profile, closure, trees["not"][0], scope=["a", "nobody"])) == []
    assert ids(Q.matching_files(profile, closure, trees["soma"][0], scope=[])) == []
    with pytest.raises(ValueError, match="unknown regions"):
        Q.matching_files(profile, closure, Q.SomaIn(Q.Regions((77,))))
    with pytest.raises(ValueError):
        Q.Threshold(A, "cable_length_um", ">", float("inf"))


def test_report_and_features(spark, profile, closure, structures):
    cohort = spark.createDataFrame([("a",), ("b",), ("zero",)], "file_id string")
    rows = {(r["is_aggregate"], r["region_id"]): r for r in G.region_report(profile, closure, structures, cohort).collect()}
    area = rows[True, 10]
    assert (area["neurons_present"], area["total_cable_mm"], area["total_termini"]) == (2, pytest.approx(3.51), 5)
    assert area["cohort_present_percent"] == pytest.approx(200 / 3) and rows[False, 0]["name"] == "Outside / unmapped"
    assert (False, 10) not in rows and rows[True, 1]["parent_id"] is None and rows[True, 11]["parent_id"] == 10
    fewer = G.region_report(profile, closure, structures, cohort, excluded=[11])
    assert {r["region_id"] for r in fewer.collect()} == {0, 1, 10, 12}
    with pytest.raises(ValueError, match="missing from the profile"):
        G.region_report(profile, closure, structures, spark.createDataFrame([("x",)], "file_id string"))
    cells = {(r["file_id"], r["group_id"]): r["value"] for r in G.regional_features(profile, closure, cohort).collect()}
    assert cells == {("a", 11): 1500.0, ("b", 11): 2000.0, ("b", 0): 250.0, ("b", 12): 10.0}
    outer = G.regional_features(profile, closure, cohort, groups=[1, 10, 11])
    assert {r["group_id"] for r in outer.collect()} == {0, 1}
    assert ids(G.zero_feature_neurons(outer, cohort)) == ["zero"]


def test_profile_round_trip_and_broken_totals(spark, profile, tmp_path):
    P.write_profile(profile, str(tmp_path / "p"))
    again = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, profile.collect()))
    totals = P.ProfileTotals(3, 19, 0, 0, 6, 3760.0)
    assert P.profile_issues(profile, totals) == []
    assert P.profile_issues(profile.union(profile), totals) == ["duplicate bucket keys", "node total", "terminus total", "cable total"]
