"""Readers, writers, filters, masks, volumes, flatmap and streams on small fixtures."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.bridge import Tables
from arborlake.functions.quantiles import percentiles
from arborlake.functions.ranks import number_rows, running_before
from arborlake.model import Grid
from arborlake.operators import catalog as C, filters as X, flatmap as M, occupancy as O, points as PT, regions as R, sets as N, volumes as V
from arborlake.plans.mask_query import neurons_in_masks
from arborlake.sources import nodes as SN, points as SP, results as SR
from arborlake.streaming import appends

XYZ = "file_id string, neuron_id string, subject string, type int, x double, y double, z double"


def test_numbers_and_running_sums_need_no_single_task(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), F.lit(2).alias("v")).repartition(7)
    assert number_rows(rows, ["k"]).filter("number <> k").count() == 0
    assert running_before(rows, ["k"], "v", "s").filter("s <> 2 * k").count() == 0


def test_percentiles_are_exact_under_one_hot_value(spark):
    values = [5.0] * 9000 + [float(v) / 7 for v in range(6000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = percentiles(rows, "v", [0, 1, 50, 99, 100], len(values))
    assert got == pytest.approx(list(np.percentile(values, [0, 1, 50, 99, 100])))


def swc(tmp_path, files):
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


FILES = {
    "11_22_x.swc": "# head\n1 1 0 0 0 1 -1\n2 2 1.5 0 0 1 1 extra\n\n 3  2 2 0\n", "sub/H1.2.3.4.5.6.7_88_m.SWC": "1 1 5 5 5 1 -1\n",
    "broken.swc": "1 1 0 0 0 1 -1\n2 2 x 0 0 1 1\n", "empty.swc": "# nothing\n1 2 3\n", "other.txt": "1 1 0 0 0 1 -1\n",
}


def test_morphology_files(spark, tmp_path):
    folder = swc(tmp_path / "in", FILES)
    found = SN.ingest_swc(spark, folder)
    rows = {(r["file_id"], r["node_id"]): r for r in found.nodes.collect()}
    assert set(rows) == {("11_22_x.swc", 1), ("11_22_x.swc", 2), ("H1.2.3.4.5.6.7_88_m.SWC", 1)}
    assert (rows["11_22_x.swc", 2]["x"], rows["11_22_x.swc", 2]["subject"], rows["11_22_x.swc", 2]["neuron_id"]) == (1.5, "22", "11")
    assert rows["H1.2.3.4.5.6.7_88_m.SWC", 1]["subject"] == "H1.2.3.4.5.6.7"
    assert {tuple(r) for r in found.failures.collect()} == {("broken.swc", "field is not a number"), ("empty.swc", "no valid nodes")}
    summary = SN.ingest_summary(found).first()
    assert (summary["discovered"], summary["processed"], summary["failed"], summary["rows_written"]) == (4, 2, 2, 3)
    assert SN.ingest_swc(spark, folder, recursive=False).nodes.select("file_id").distinct().count() == 1


def test_append_keeps_known_files(spark, tmp_path):
    found = SN.ingest_swc(spark, swc(tmp_path / "in", FILES)).nodes
    path = str(tmp_path / "t")
    SN.write_nodes(found.filter("file_id = '11_22_x.swc'"), path)
    SN.append_nodes(spark, path, found)
    SN.append_nodes(spark, path, found)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        SN.scan_nodes(spark, str(tmp_path / "missing"))


def test_streams_add_only_new_files(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "state")
    swc(folder, {"a_1.swc": "1 1 0 0 0 1 -1\n2 2 1 0 0 1 1\n"})
    for _ in range(2):
        appends.stream_append_swc(spark, str(folder), table, state).awaitTermination()
    swc(folder, {"b_1.swc": "1 1 0 0 0 1 -1\n", "late/a_1.swc": "9 1 0 0 0 1 -1\n"})
    appends.stream_append_swc(spark, str(folder), table, state).awaitTermination()
    assert sorted((r["file_id"], r["node_id"]) for r in spark.read.parquet(table).collect()) == [("a_1.swc", 1), ("a_1.swc", 2), ("b_1.swc", 1)]


def test_point_stream_sets_bad_rows_aside(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "state")
    swc(folder, {"one.csv": "label,x,y,z,note\nA,1,2,3,n\n,1,2,3,n\nB,1,no,3,n\n"})
    appends.stream_append_points(spark, str(folder), table, state).awaitTermination()
    swc(folder, {"two.csv": "label,x,y,z,note\nC,4,5,6,m\n"})
    appends.stream_append_points(spark, str(folder), table, state).awaitTermination()
    rows = sorted((r["label"], r["y"], r["origin_csv"], r["note"]) for r in appends.streamed_points(spark, table).collect())
    assert rows == [("A", 2.0, "one.csv", "n"), ("C", 5.0, "two.csv", "m")]
    assert spark.read.json(f"{table}_rejected").count() == 2


def test_each_point_file_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "p"
    swc(folder, {"a.csv": "label,x,y,z\nA,10,20,30\n", "b b.csv": "label,z,y,x,id,more\nB,30,20,10,77,m\n", "c.csv": "\ufeffz,label,y,x\n30,C,20,10\n", "empty.csv": "",
                 "two.csv": HEADER + "M,1,2,3,9,c,10,20,30,Area,A1,11,left\n"})
    rows = {r["label"]: r for r in SP.read_points_csv(spark, str(folder)).collect()}
    assert {k: (r["x"], r["y"], r["z"], r["id"], r["more"], r["origin_csv"]) for k, r in rows.items()} == {
        "A": (10.0, 20.0, 30.0, None, None, "a.csv"), "B": (10.0, 20.0, 30.0, 77, "m", "b b.csv"), "C": (10.0, 20.0, 30.0, None, None, "c.csv"),
        "M": (10.0, 20.0, 30.0, 11, None, "two.csv")}
    assert SP.infer_points_format(spark, str(folder)) == "standard,two-row"
    swc(folder, {"odd.csv": "p,q\n1,2\n"})
    with pytest.raises(SP.PointFormatError, match="odd.csv"):
        SP.read_points_csv(spark, str(folder))


def test_point_stream_reads_each_header(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "state")
    swc(folder, {"a.csv": "label,x,y,z\nA,10,20,30\n", "b.csv": "z,y,x,label,id,more\n30,20,10,B,7,m\n30,20,10,B,7.5,m\n30,20,10,B,abc,m\n", "odd.csv": "p,q\n1,2\n"})
    appends.stream_append_points(spark, str(folder), table, state).awaitTermination()
    swc(folder, {"two.csv": HEADER + "M,1,2,3,9,c,10,20,30,Area,A1,11,left\n"})
    appends.stream_append_points(spark, str(folder), table, state).awaitTermination()
    rows = sorted((r["label"], r["x"], r["z"], r["id"], r["more"], r["strength"]) for r in appends.streamed_points(spark, table).collect())
    assert rows == [("A", 10.0, 30.0, None, None, None), ("B", 10.0, 30.0, 7, "m", None), ("M", 10.0, 30.0, 11, None, "9")]
    bad = sorted((r["file"].rsplit("/", 1)[-1], r["reason"]) for r in spark.read.json(f"{table}_rejected").collect())
    assert bad[:2] == [("b.csv", "id"), ("b.csv", "id")] and bad[2][0] == "odd.csv" and len(bad) == 3


def test_written_morphology_is_read_back(spark, tmp_path):
    found = SN.ingest_swc(spark, swc(tmp_path / "in", FILES | {"odd name=1.swc": "1 1 0.1235 0 0 1 -1\n"})).nodes
    out = str(tmp_path / "out")
    SN.write_swc(found, out)
    again = SN.ingest_swc(spark, out)
    assert again.failures.count() == 0
    keep = ["file_id", "node_id", "type", F.round("x", 3).alias("x"), "parent_id"]
    assert sorted(map(tuple, again.nodes.select(*keep).collect())) == sorted(map(tuple, found.select(*keep).collect()))
    SN.write_swc(found, out)
    assert SN.ingest_swc(spark, out).nodes.count() == found.count()
    with pytest.raises(FileExistsError):
        SN.write_swc(found, out, mode="error")


HEADER = "Marker,Experiment,,,,Channels,Atlas,,,Region,,,\nMarker,x,y,z,strength,channel mono channel,x,y,z,name,acronym,id,hemisphere\n"


def test_point_formats(spark, tmp_path):
    folder = tmp_path / "p"
    swc(folder, {"std.csv": "label,x,y,z,id\n A ,1,2,3,\nB,1,2,3,7\n", "two.csv": HEADER + "M,1,2,3,9,c,4,5,6,Area,A1,11,left\n", "raw.csv": "m,px,py,pz,z\nA,1,2,3,q\n"})
    at = lambda n: str(folder / n)
    assert SP.infer_points_format(spark, at("std.csv")) == "standard" and SP.infer_points_format(spark, at("two.csv")) == "two-row"
    rows = SP.read_points_csv(spark, at("std.csv")).orderBy("label").collect()
    assert [(r["label"], r["id"], r["origin_csv"], r["acronym"]) for r in rows] == [("A", None, "std.csv", None), ("B", 7, "std.csv", None)]
    row = SP.read_points_csv(spark, at("two.csv")).first()
    assert (row["label"], row["x"], row["region_name"], row["id"], row["strength"], row["experiment_z"]) == ("M", 4.0, "Area", 11, "9", "3")
    with pytest.raises(SP.PointFormatError, match="give a mapping"):
        SP.infer_points_format(spark, at("raw.csv"))
    with pytest.raises(SP.PointFormatError, match="clash"):
        SP.read_points_csv(spark, at("raw.csv"), {"label": "m", "x": "px", "y": "py", "z": "pz"})
    for bad in ({"label": "m"}, {"label": "m", "x": "m", "y": "b", "z": "c"}, {"label": "a", "x": "b", "y": "c", "z": "d", "who": "e"}):
        with pytest.raises(SP.PointFormatError):
            SP.check_mapping(bad)
    bad = spark.createDataFrame([(" ", "1", "x", "3", "1.5")], "label string, x string, y string, z string, id string")
    with pytest.raises(SP.PointFormatError, match="'label': 1.*'y': 1.*'id': 1"):
        SP.validate_points(bad)


def test_points_against_the_atlas_reverse_axes(spark):
    grid = Grid.cubic((5, 5, 5), 25.0)
    cells = [(a, b, c, {(4, 3, 2): 101, (2, 2, 1): 202}.get((a, b, c), 0)) for a, b, c in itertools.product(range(5), repeat=3)]
    annotation = spark.createDataFrame(cells, "ai int, bi int, ci int, region_id int")
    structures = spark.createDataFrame([(101, "P1", "Primary/one"), (202, "S2", "Second")], "id int, acronym string, name string")
    rows = [("p", 50.0, 75.0, 100.0, "primary, one", "P1", 101, "right"), ("q", 25.0, 50.0, 50.0, "Second", "XX", 101, "LEFT"), ("r", 900.0, 0.0, 0.0, None, "", None, None)]
    points = spark.createDataFrame(rows, "label string, x double, y double, z double, region_name string, acronym string, id long, hemisphere string")
    got = {r["label"]: (r["atlas_id"], r["mismatch_fields"]) for r in PT.validate_points_atlas(points, annotation, structures, grid).collect()}
    assert got == {"p": (101, ""), "q": (202, "id,acronym,hemisphere"), "r": (0, "")}


def test_append_schema(spark):
    a = spark.createDataFrame([("A", 1.0)], "label string, x double")
    for other, text in ((a.select("x", "label"), "order"), (a.select("label"), "missing"), (a.withColumn("y", F.lit(1)), "extra"), (a.withColumn("x", F.lit(1)), "is int")):
        with pytest.raises(SP.PointFormatError, match=text):
            SP.check_append_schema(other, a)
    both = SP.appended_points(a, a.withColumn("origin_csv", F.lit(" ")))
    assert [r["origin_csv"] for r in both.collect()] == ["(not recorded)"] * 2


def test_search_files(spark, tmp_path):
    ref = spark.createDataFrame([("r",)], "file_id string")
    hits = spark.createDataFrame([(1, "a", 0.25), (2, "b", 1.5)], "rank int, file_id string, pearson_distance double")
    path = str(tmp_path / "s")
    SR.write_search_csv(ref, hits, {"note": 'say "hi", now', "n": [1, 2]}, path)
    rows = SR.read_search_csv(spark, path, spark.createDataFrame([("a",)], "file_id string")).orderBy("rank").collect()
    assert [(r["row_role"], r["rank"], r["file_id"], r["pearson_distance"], r["available"]) for r in rows] == [
        ("reference", 0, "r", None, False), ("search_result", 1, "a", 0.25, True), ("search_result", 2, "b", 1.5, False)]
    good = SR.search_rows(ref, hits, "{}")
    damage = {
        "duplicate file_id": good.unionByName(good.filter("rank = 1").withColumn("rank", F.lit(3).cast("long"))),
        "contiguous": good.filter("rank <> 1"), "no reference": good.filter("rank > 0"), "no result": good.filter("rank = 0"),
        "lie in": good.withColumn("pearson_distance", F.when(F.col("rank") > 0, 3.0)), "conflicting": good.withColumn("search_context_json", F.concat(F.lit("["), "rank", F.lit("]"))),
        "invalid": good.withColumn("search_context_json", F.lit("{oops")), "version": good.withColumn("format_version", F.lit(7)),
    }
    for text, rows in damage.items():
        assert any(text in p for p in SR.search_problems(rows)), text
    old = tmp_path / "old.csv"
    old.write_text("format_version,file_id,pearson_distance\n1,z,0.5\n1,y,0.5\n1,x,0.1\n")
    assert [(r["rank"], r["file_id"]) for r in SR.read_search_csv(spark, str(old)).orderBy("rank").collect()] == [(1, "x"), (2, "y"), (3, "z")]


def test_tags_and_grid_spec(spark, tmp_path):
    rows = spark.createDataFrame([('["a", "b"]',), ("plain",), ('{"a": 1}',), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(SR.decode_tags("t")).collect()] == [["a", "b"], ["plain"], [], [], []]
    spec = {"x_bounds": [0.0, 2.0], "y_bounds": [0.0, 1.0], "depth_bounds": [0.0, 10.0]}
    SR.write_grid_spec(spark, {"shaped": spec}, str(tmp_path / "g"))
    assert SR.read_grid_spec(spark, str(tmp_path / "g"), "shaped") == spec and SR.read_grid_spec(spark, str(tmp_path / "g"), "square") is None
    grid = M.grid_for(rows, "shaped", SR.read_grid_spec(spark, str(tmp_path / "g"), "shaped"), y_bins=5)
    assert (grid.x_bins, grid.valid_depth_bins) == (10, 1)


def test_annotation_rules(spark):
    rows = spark.createDataFrame([("n", "L", []), ("a", "L", ["a"]), ("ab", "M", ["a", "b"]), ("b", "L", ["b"])], "file_id string, label string, tags array<string>")
    rule = X.AnnotationRule
    expect = {
        rule(): "n a ab b", rule(label="L"): "n a b", rule(tags=""): "n", rule(tags="a"): "a ab", rule(tags=("a", "b"), match="any"): "a ab b",
        rule(tags=("a", "b")): "ab", rule(tags=("b", "a"), match="exact"): "ab", rule(tags=("a",), match="exact"): "a", rule(count="single"): "a b",
        rule(count="multiple"): "ab", rule(tags="a", excluded=("b",)): "a", rule(excluded=("a", "b")): "n",
    }
    for r, names in expect.items():
        assert {x["file_id"] for x in X.annotation_filter(rows, r).collect()} == set(names.split()), r
    with pytest.raises(ValueError):
        rule(match="some")


def test_natural_order(spark):
    from arborlake.functions import natural_key

    names = ["b10", "B2", "b2", "a", "10", "9", "a1", "A1x"]
    rows = spark.createDataFrame([(n,) for n in names], "l string").orderBy(natural_key("l"), "l")
    assert [r[0] for r in rows.collect()] == ["9", "10", "a", "a1", "A1x", "B2", "b2", "b10"]


def test_stored_runs(spark):
    empty = spark.createDataFrame([], "assignment_id string, file_id string, label int")
    cohort = spark.createDataFrame([("a",), ("b",)], "file_id string")
    labels = spark.createDataFrame([("a", 3)], "file_id string, label int")
    runs = N.Assignments(empty, empty.select("assignment_id", "file_id")).add("1", labels, cohort, "First", "first").add("2", labels, cohort, "Second", "second", scope="x")
    assert [r["name"] for r in runs.rename("1", " Mine ").runs] == ["Mine", "Second"]
    assert {r["file_id"]: r["label"] for r in runs.label_map("2").collect()} == {"a": 3, "b": None}
    assert [r[0] for r in runs.unassigned("1").collect()] == ["b"] and [r[0] for r in runs.files_with("2", 3).collect()] == ["a"]
    assert len(runs.drop("1").runs) == 1
    for twin in (("2", "New", "new"), ("3", "FIRST", "new"), ("3", "New", "second"), ("3", " ", "new")):
        with pytest.raises(ValueError):
            runs.add(twin[0], labels, cohort, *twin[1:])
    with pytest.raises(ValueError):
        runs.rename("1", "second")


@pytest.mark.parametrize("seed", [0, 1])
def test_mask_scan_against_a_point_loop(spark, seed):
    rng = np.random.default_rng(seed)
    shape, resolution = (5, 6, 7), (20.0, 15.0, 10.0)
    points = rng.uniform(-20, 120, size=(1031, 3))
    points[:4, 0] = [np.nan, np.inf, -np.inf, np.nan]
    rows = [(f"f{i % 37}", "n", "s", int(i % 5), *map(float, p)) for i, p in enumerate(points)]
    mask = rng.random(shape) < 0.2
    cells = spark.createDataFrame([tuple(map(int, c)) for c in np.argwhere(mask)], "ai int, bi int, ci int")
    got = {r["file_id"] for r in neurons_in_masks(spark.createDataFrame(rows, XYZ), Grid(shape, resolution), [cells], node_types=[1, 2]).collect()}
    expected = set()
    for name, _, _, kind, *p in rows:
        if kind in (1, 2) and all(map(math.isfinite, p)):
            v = [math.floor(c / r) for c, r in zip(p, resolution)]
            if all(0 <= i < n for i, n in zip(v, shape)) and mask[tuple(v)]:
                expected.add(name)
    assert got == expected


def test_empty_lists_and_null_types(spark):
    rows = spark.createDataFrame([("a", "n", "s", None, 1.0, 1.0, 1.0), ("b", "n", "s", 1, 1.0, 1.0, 1.0)], XYZ).withColumn("node_id", F.lit(1))
    assert X.scope_filter(rows, []).count() == 0 and C.soma_nodes(rows, []).count() == 0
    assert X.node_type_filter(rows, "exclude", [1]).count() == 1 and X.node_type_filter(rows, "include", []).count() == 0
    assert C.soma_locations(rows.withColumn("region_acronym", F.lit("A")), []).count() == 1
    assert X.exclude_near_soma(rows, rows, 0.0).count() == 0 and X.within_soma_radius(rows, rows, 0.0).count() == 1
    assert X.scope_filter(rows, [f"x{i}" for i in range(2000)] + ["a"]).count() == 1


def full(values):
    return {tuple(map(int, k)): float(values[tuple(k)]) for k in np.argwhere(values != 0)}


def cells_of(spark, values, name="n"):
    return spark.createDataFrame([(*k, v) for k, v in full(values).items()], f"ai int, bi int, ci int, {name} double")


def test_smoothing_matches_a_dense_filter(spark):
    rng = np.random.default_rng(4)
    values = (rng.random((6, 5, 1)) < 0.3) * rng.integers(1, 9, (6, 5, 1)).astype(float)
    weights = np.array(V.gaussian_weights(1.2))
    radius = len(weights) // 2
    dense = values
    for axis in range(3):
        padded = np.pad(dense, [(radius, radius) if a == axis else (0, 0) for a in range(3)], mode="edge")
        dense = sum(w * np.take(padded, range(k, k + dense.shape[axis]), axis=axis) for k, w in enumerate(weights))
    got = {(r["ai"], r["bi"], r["ci"]): r["n"] for r in V.smooth_heatmap(cells_of(spark, values), Grid((6, 5, 1), (1.0, 1.0, 1.0)), 1.2).collect()}
    for k in np.ndindex(*values.shape):
        assert got.get(k, 0.0) == pytest.approx(dense[k], abs=1e-12)


def test_dilation_reaches_the_volume(spark):
    grid = Grid((12, 12, 12), (10.0, 10.0, 20.0))
    core = [c for c in itertools.product(range(12), repeat=3) if all(4 <= v <= 6 for v in c)]
    mask = spark.createDataFrame(core, "ai int, bi int, ci int")
    got = {tuple(r) for r in R.dilate_mask(mask, grid, 1.0).collect()}
    far = {c: min(math.dist([v * s for v, s in zip(c, grid.resolution)], [v * s for v, s in zip(d, grid.resolution)]) for d in core) for c in itertools.product(range(12), repeat=3)}
    reach = max(far[c] for c in got)
    assert got == {c for c, d in far.items() if d <= reach}
    sizes = [sum(d <= t for d in far.values()) for t in sorted(set(far.values()))]
    assert abs(len(got) - 54) == min(abs(s - 54) for s in sizes)
    with pytest.raises(ValueError, match="empty"):
        R.dilate_mask(mask.limit(0), grid)


def test_otsu_and_contrast_edges(spark):
    none = spark.createDataFrame([], "ai int, bi int, ci int, n double")
    assert V.otsu_threshold(none).first()[0] == 0.0
    flat = cells_of(spark, np.full((2, 2, 2), 3.0))
    assert V.otsu_threshold(flat).first()[0] == 3.0
    two = cells_of(spark, np.array([1.0, 1.2, 1.1, 9.0, 9.1, 9.3, 8.9, 1.0]).reshape(2, 2, 2))
    assert 1.2 < V.otsu_threshold(two).first()[0] < 9.0
    assert V.heatmap_to_mask(none, Grid((2, 2, 2), (1.0,) * 3))[1].count() == 0
    pairs = spark.createDataFrame([(float(v),) for v in range(101)], "distance double")
    found = V.matrix_contrast(pairs, diagonal=[-1.0])
    assert (found["minimum"], found["maximum"], found["lower"], found["upper"]) == (-1.0, 100.0, 1.0, 99.0)
    assert V.matrix_contrast(pairs.limit(0))["maximum"] == 1.0


def test_slab_always_holds_a_layer(spark):
    grid = Grid((4, 3, 2), (10.0, 10.0, 10.0))
    volume = cells_of(spark, np.arange(1.0, 25.0).reshape(4, 3, 2))
    thin = {(r["row"], r["column"]): r["n"] for r in V.reduce_volume(volume, grid, "coronal", slab=True, position=14.0, thickness=1.0).collect()}
    assert thin == {(b, c): float(6 + b * 2 + c + 1) for b in range(3) for c in range(2)}


def test_flat_bins_clamp_and_sentinel(spark):
    rows = [("a", 0.0, 0.0, 5.0, True, True), ("a", 2.0, 1.0, 99.0, True, True), ("a", 1.0, 0.5, -1.0, True, False), ("b", 0.5, 0.5, 5.0, False, True), ("b", 1.0, 0.5, -7.0, True, False)]
    df = spark.createDataFrame(rows, "file_id string, x_flat double, y_flat double, depth_um double, flatmap_valid boolean, depth_valid boolean")
    grid = M.FlatGrid("", (0.0, 2.0), (0.0, 1.0), (0.0, 40.0), y_bins=4, depth_bin_um=10.0)
    got = sorted((r["depth_bin"], r["y_bin"], r["x_bin"]) for r in M.flatmap_bins(df, grid).collect())
    assert (grid.x_bins, grid.planes) == (8, 6) and got == [(0, 2, 4), (1, 0, 0), (5, 3, 7)]
    assert M.flatmap_bins(df, M.FlatGrid("", (0.0, 2.0), (0.0, 1.0), (0.0, 40.0), depth_minus_one=False)).count() == 2
    assert M.FlatGrid("", (3.0, 3.0), (0.0, 1.0)).x_bounds == (2.5, 3.5)
    fine = M.FlatGrid("", (0.0, 1.0), (0.0, 1.0), (0.0, 1e6), y_bins=65536, depth_bin_um=10.0)
    last = M.flatmap_bins(df, fine).select(M.linear_bin(fine).alias("v")).agg({"v": "max"}).first()[0]
    assert fine.cells > 1 << 48 and last > 1 << 32
    segments = spark.createDataFrame([("a", 1, 2, 0.0, 0.0, 1.0, 1.0)] * 3, "file_id string, parent_id int, node_id int, x1 double, y1 double, x2 double, y2 double")
    assert M.segment_pixels(segments, grid).count() == 3


def test_faces_of_one_and_two_bins(spark):
    bins = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 0), (2, 0, 0, 1)], "region_id int, z long, y long, x long")
    vertices, triangles = O.region_faces(bins)
    count = lambda df: {r[0]: r[1] for r in df.groupBy("region_id").count().collect()}
    assert count(vertices) == {1: 8, 2: 12} and count(triangles) == {1: 12, 2: 20}
    edges = triangles.select("region_id", F.explode(F.array(*[F.array_sort(F.array(a, b)) for a, b in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e"))
    assert edges.groupBy("region_id", "e").count().filter("count <> 2").count() == 0
    assert count(O.region_outlines(bins)) == {1: 4, 2: 6}
    far = bins.unionByName(spark.createDataFrame([(1, 5, 5, 5)], bins.schema))
    assert {r[0]: r[1] for r in O.region_components(far).collect()} == {1: 2, 2: 1}


def test_one_file_with_a_third_of_all_nodes(spark, tmp_path):
    """A hot supplier gives one huge neuron; numbering, trees and counts stay whole."""
    import shutil

    source = "/root/testdata/sf0.001"
    for name in ("lineitem", "supplier", "events"):
        shutil.copy(f"{source}/{name}.parquet", tmp_path / f"{name}.parquet")
    items = spark.read.parquet(f"{source}/lineitem.parquet")
    hot = items.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("l_suppkey")))
    out = tmp_path / "skewed"
    out.mkdir()
    hot.write.parquet(str(out / "lineitem.parquet"))
    nodes = Tables(spark, str(out)).nodes
    sizes = nodes.groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("d"), F.max("node_id").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] for r in sizes) and max(r["n"] for r in sizes) > items.count() / 3
    from arborlake.operators import topology as T

    assert T.edges(nodes).count() == items.count() - len(sizes)
    assert {(r["reached"], r["total"]) for r in T.reachable_counts(nodes).collect()} == {(r["n"], r["n"]) for r in sizes}


def plan_of(df) -> str:
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_mask_scan_reads_few_columns_and_pushes_its_box(spark, tmp_path, grid):
    path = str(tmp_path / "nodes")
    Tables(spark, "/root/testdata/sf0.001").nodes.write.parquet(path)
    mask = spark.createDataFrame([(4, 2, 3), (5, 3, 4)], "ai int, bi int, ci int")
    plan = plan_of(neurons_in_masks(spark.read.parquet(path), grid, [mask], node_types=[2]))
    scan = plan[plan.index("Scan parquet"):]
    assert "GreaterThanOrEqual(x,100.0)" in scan and "LessThan(x,150.0)" in scan and "radius" not in scan
    counted = plan_of(V.voxel_counts(spark.read.parquet(path), 25.0))
    assert counted.count("Exchange") == plan_of(spark.read.parquet(path).groupBy("file_id").count()).count("Exchange")


def test_region_query_is_one_scan(spark):
    from arborlake.plans import region_query as Q

    profile = spark.createDataFrame([("a", 1, "unknown", "neurite", 1.0, 1, 1)], "file_id string, region_id int, laterality string, compartment string, cable_length_um double, node_count long, terminus_count long")
    closure = spark.createDataFrame([(1, 1, 0), (2, 2, 0)], "ancestor_region_id int, direct_region_id int, depth int")
    leaf = lambda r: Q.NeuriteIn(Q.Regions((r,)))
    plan = plan_of(Q.matching_files(profile, closure, Q.AllOf((leaf(1), Q.Not(leaf(2)), Q.Threshold(Q.Regions((1,)), "node_count", ">", 0)))))
    assert plan.count("Scan ExistingRDD") <= 2 and "Join" not in plan
