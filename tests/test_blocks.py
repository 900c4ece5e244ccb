"""Block volumes, distance transforms and stencils against plain loops; joins under heavy keys."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake import session as S
from arborlake.model import Grid
from arborlake.operators import blocks as B, regions as R, volumes as V
from arborlake.operators.stencil import _envelope, beside, offsets_to_nearest

GRID = Grid((70, 45, 38), (25.0, 25.0, 25.0))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sparse(spark, cells, kinds="ai long, bi long, ci long, region_id int"):
    return spark.createDataFrame(cells, kinds).repartition(3)


def some_cells(seed, n, grid=GRID):
    rng = random.Random(seed)
    return list({tuple(rng.randrange(s) for s in grid.shape): None for _ in range(n)})


def nodes_of(spark, seed, n, grid=GRID):
    rng = random.Random(seed)
    rows = [("f", k, *[rng.uniform(-60, e + 60) for e in grid.extent]) for k in range(n)]
    # a crowded voxel, and places without a voxel
    rows += [("hot", k, 30.0, 30.0, 30.0) for k in range(n)] + [("bad", 0, math.nan, 1.0, 1.0), ("bad", 1, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "file_id string, node_id int, x double, y double, z double").repartition(4)


@pytest.mark.parametrize("heavy", [0.5, 1e9, 1e-9])
def test_values_at_voxels(spark, monkeypatch, heavy):
    cells = [(*c, (k * 7) % 50 if k % 5 else None) for k, c in enumerate(some_cells(1, 4000))] + [(1, 1, 1, 99)]
    cells = list({c[:3]: c for c in cells}.values())
    at, nodes = {c[:3]: c[3] for c in cells}, nodes_of(spark, 2, 300)
    volume = sparse(spark, cells).select(GRID.linear().alias("_voxel"), "region_id", (F.col("region_id") * 0.5).alias("half"))
    monkeypatch.setattr(S, "HEAVY_SHARE", heavy)
    rows = V.voxel_of(nodes, GRID)
    small = B.at_voxels(rows, "_voxel", volume, GRID, ["region_id", "half"])
    in_blocks = B.block_volume(volume, GRID, "_voxel", ["region_id", "half"])
    large = B.at_voxels(rows, "_voxel", in_blocks.settled(), GRID, ["region_id", "half"])
    assert sorted(map(str, small.collect())) == sorted(map(str, large.select(*small.columns).collect()))
    for r in large.collect():
        inside = r["x"] is not None and not math.isnan(r["x"])
        want = at.get(tuple(math.floor(r[c] / 25) for c in "xyz")) if inside else None
        assert r["region_id"] == want and r["half"] == (None if want is None else want / 2)


def test_a_large_volume_is_not_copied(spark, no_broadcast):
    """10^8 voxels: the plan groups them into blocks and joins those; nothing repeats a voxel per salt."""
    grid = Grid((1000, 400, 250), (25.0,) * 3)
    key = F.col("id")
    volume = spark.range(100_000_000).select(F.floor(key / 100_000).alias("ai"), F.floor(key / 250 % 400).alias("bi"), (key % 250).alias("ci"), (1 + key % 900).cast("int").alias("region_id"))
    structures = spark.createDataFrame([(1, "one", "o")], "id int, name string, acronym string")
    nodes = nodes_of(spark, 3, 20, grid).selectExpr("*", "1 AS type", "1D AS radius", "-1 AS parent_id", "0 AS region_id", "'' AS region_name", "'' AS region_acronym")
    text = plan(R.annotate_regions(nodes, volume, structures, grid))
    assert "FlatMapGroupsInArrow" in text and text.count("Range (0, 100000000") == 1
    side = text[text.index("FlatMapGroupsInArrow"):text.index("Range (0, 100000000")]
    assert "Generate" not in side and side.count("Exchange") == 1 and "BroadcastNestedLoop" not in text


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("share", [0.0, 0.5, 1e9])
def test_lookup_join_with_heavy_keys(spark, no_broadcast, monkeypatch, how, share):
    monkeypatch.setattr(S, "HEAVY_SHARE", share)
    rows = [(1 if k % 3 == 0 else None if k % 50 == 1 else k, k % 2, k) for k in range(600)]
    big = spark.createDataFrame(rows, "a long, b long, v long").repartition(4)
    table = spark.createDataFrame([(k, k % 2, k * 10) for k in range(400)], "a long, b long, w long")
    want = sorted(map(str, big.join(table, ["a", "b"], how).collect()))
    assert sorted(map(str, S.lookup_join(big, table, ["a", "b"], how).collect())) == want


def test_heavy_keys_are_named(spark):
    big = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert S.heavy_keys(big, ["k"]) == [big.filter("k = 7").select(F.xxhash64("k")).first()[0]]
    assert S.heavy_keys(big.limit(0), ["k"]) == []


def test_envelope_against_all_rows():
    rng = np.random.default_rng(3)
    for spacing, most in ((1.0, 50.0), (2.5, 1e9), (0.7, 4.0)):
        line, place, floor = [], [], []
        for k in range(40):
            at = np.sort(rng.choice(30, rng.integers(1, 12), replace=False))
            line += [k * 3] * len(at)
            place += at.tolist()
            floor += (rng.integers(0, 6, len(at)) ** 2 * 0.5).tolist()
        line, place, floor = np.array(line), np.array(place), np.array(floor)
        row, cell = _envelope(line, place, floor, spacing, 30, most)
        found = {(line[r], c): floor[r] + (spacing * (c - place[r])) ** 2 for r, c in zip(row, cell)}
        for k in np.unique(line):
            mine = line == k
            for c in range(30):
                want = (floor[mine] + (spacing * (c - place[mine])) ** 2).min()
                assert (found.get((k, c)) == pytest.approx(want)) if want <= most else (k, c) not in found


@pytest.mark.parametrize("resolution", [(25.0, 25.0, 25.0), (10.0, 25.0, 40.0)])
def test_distances_are_those_of_the_ball(spark, resolution):
    grid, radius = Grid((40, 37, 35), resolution), 110.0
    cells = some_cells(5, 60, grid) + [(0, 0, 0), (39, 36, 34)]
    found = offsets_to_nearest(spark.createDataFrame(cells, "ai long, bi long, ci long"), grid, radius, V.VOXEL).collect()
    points = np.array(cells) * np.array(resolution)
    want = {}
    for at in itertools.product(*map(range, grid.shape)):
        d = math.sqrt((((points - np.array(at) * np.array(resolution)) ** 2).sum(axis=1)).min())
        if d <= radius * (1 - 1e-9):
            want[at] = d
    got = {(r["ai"], r["bi"], r["ci"]): math.sqrt(sum((r[d] * s) ** 2 for d, s in zip(("da", "db", "dc"), resolution))) for r in found}
    assert len(got) == len(found) and set(want) <= set(got)
    assert all(got[at] == pytest.approx(d) for at, d in want.items())
    for r in found:
        assert (r["ai"] - r["da"], r["bi"] - r["db"], r["ci"] - r["dc"]) in set(map(tuple, cells))


def test_dilation_needs_rows_of_the_surface_only(spark):
    """A solid cube of 40 voxels a side: no pass makes more rows than surface times twice the radius."""
    grid = Grid((80, 80, 80), (25.0,) * 3)
    cube = spark.range(64_000).select(*[(F.floor(F.col("id") / 40**k) % 40 + 20).cast("long").alias(n) for k, n in enumerate(V.VOXEL)])
    grown = R.dilate_mask(cube, grid, 0.2).distinct().count()
    assert abs(grown - 64_000 * 1.2) < 64_000 * 0.05
    text = plan(offsets_to_nearest(cube, grid, 50.0, V.VOXEL))
    assert text.count("FlatMapGroupsInArrow") == 3 and "Generate" not in text


@pytest.mark.parametrize("present", [False, True])
def test_neighbours_across_blocks(spark, present):
    rng = random.Random(8)
    cells = {(rng.randrange(28, 70), rng.randrange(28, 36), rng.randrange(-3, 4), rng.choice([1, 2, None])) for _ in range(900)}
    frame = spark.createDataFrame(list(cells), "z long, y long, x long, region_id int").repartition(3)
    ways = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    found = beside(frame, ("z", "y", "x"), ways, group="region_id", present=present)
    got = sorted(map(str, [(r["z"], r["y"], r["x"], r["region_id"], r["way"]) for r in found.collect()]))
    want = [(*c, w) for c in cells for w, d in enumerate(ways) if ((*[a + b for a, b in zip(c, d)], c[3]) in cells) == present]
    assert got == sorted(map(str, want)) and plan(found).count("Exchange") == 1


@pytest.mark.parametrize("sigma", [0.7, 2.0, 9.0])
def test_smoothing_across_blocks(spark, sigma):
    grid = Grid((70, 33, 12), (25.0,) * 3)
    dense = np.zeros(grid.shape)
    for k, c in enumerate(some_cells(11, 25, grid) + [(0, 0, 0), (69, 32, 11)]):
        dense[c] = k + 1
    rows = [(*map(int, c), int(dense[tuple(c)])) for c in np.argwhere(dense)]
    frame = spark.createDataFrame(rows, "ai long, bi long, ci long, n long")
    smooth = V.smooth_heatmap(frame, grid, sigma)
    weights = V.gaussian_weights(sigma)
    reach = len(weights) // 2
    want = dense
    for axis in range(3):
        pad = np.pad(want, [(reach, reach) if a == axis else (0, 0) for a in range(3)], mode="edge")
        want = sum(w * np.take(pad, range(k, k + grid.shape[axis]), axis) for k, w in enumerate(weights))
    got = np.zeros(grid.shape)
    found = smooth.collect()
    for r in found:
        got[r["ai"], r["bi"], r["ci"]] = r["n"]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-14) and len(found) == np.count_nonzero(want > 0)
    assert plan(smooth).count("Exchange") == 1
