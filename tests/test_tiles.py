"""What follows from tiles of vectors or points without a row per pair, against brute force."""

import dataclasses
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import clustering as K, linkage as L, pearson as P


def counted(spark, files, voxels, seed):
    """Counts of which many are equal, so that many distances are."""
    rng = np.random.default_rng(seed)
    rows = [(f"f{f:03d}", int(v) << 30, int(c)) for f in range(files) for v, c in enumerate(rng.integers(0, 3, voxels)) if c]
    return spark.createDataFrame(rows + [(None, 1, 1)], "file_id string, voxel long, c long")


def never(spark, *names):
    """Pairs that nobody may read."""
    return spark.range(1).select(*[F.raise_error(F.lit("a pair was read")).cast("string").alias(n) for n in names[:2]], F.lit(1.0).alias(names[2]))


def merges(tree):
    return sorted((r["node"], r["left_node"], r["right_node"], r["height"], r["size"]) for r in tree.merges.collect())


def test_tile_edges_are_the_spanning_tree():
    rng = np.random.default_rng(3)
    for n, m in itertools.product((1, 2, 7, 20), (0, 1, 5, 16)):
        names = rng.permutation(60)[: n + m]
        left, right = names[:n], names[n:]
        apart = rng.integers(0, 4, (n, m or n)).astype(float)
        apart = apart if m else np.minimum(apart, apart.T)
        x, y = np.triu_indices(n, 1) if not m else [v.ravel() for v in np.meshgrid(range(n), range(m), indexing="ij")]
        ends, d = (left[x], (right if m else left)[y]), apart[x, y]
        a, b = np.minimum(*ends), np.maximum(*ends)
        kept = L.forest(a, b, d, 60)
        got = L.tile_tree_edges(apart, left, right if m else None, 60)
        assert sorted(zip(*(e.tolist() for e in got))) == sorted(zip(a[kept].tolist(), b[kept].tolist(), d[kept].tolist()))


@pytest.mark.parametrize("cells", [1, 1 << 23])
def test_single_linkage_reads_no_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(K, "BLOCK_CELLS", cells * 40)
    found = P.pearson(counted(spark, 23, 9, 1))
    ids = found.ids.filter("file_id IS NOT NULL")
    want = merges(K.hierarchical(found.distances().select("*"), ids, "single"))  # from the pairs
    unread = dataclasses.replace(found, pairs=never(spark, "i", "j", "r"))
    assert len(want) == 22 and merges(K.hierarchical(unread.distances(), ids, "single")) == want
    points = spark.createDataFrame([(f"n{k:02d}", float(k % 4), float(k % 3), 1.0) for k in range(21)], "file_id string, x double, y double, z double")
    pairs = K.soma_distances(points)
    blind = never(spark, "i", "j", "distance")
    blind._points = pairs._points
    assert merges(K.hierarchical(blind, points, "single")) == merges(K.hierarchical(pairs.select("*"), points, "single"))


def test_points_that_are_not_finite_take_the_pairs(spark):
    points = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", None)], "file_id string, x double")
    names = spark.createDataFrame([(f, k) for k, f in enumerate("abc")], "file_id string, number long")
    assert K._tile_tree(K.soma_distances(points, ["x"]), names, 3) is None
    assert K._tile_tree(K.soma_distances(points.filter("file_id <> 'c'"), ["x"]), names, 3) is None
    tree = K._tile_tree(K.soma_distances(points.filter("file_id <> 'c'"), ["x"]), names.filter("number < 2"), 2)
    assert tree.tolist() == [[2.0, 0.0, 1.0]]
