"""What moves between tasks grows no faster than the rows: plans and copies on small tables."""

import re

import pytest

from pyspark.sql import functions as F

from arborlake.model import Grid
from arborlake.operators import profile as P

GRID = Grid.cubic((16, 10, 12), 25.0, 150.0)


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def tree(spark, n=40, files=("a", "b", None)):
    """Long zigzag edges, so that an edge crosses many voxels; node numbers beyond one group."""
    rows = []
    for f in files:
        for k in range(1, n + 1):
            node = k + (70_000 if k > n // 2 else 0)
            parent = -1 if k == 1 else k - 1 + (70_000 if k - 1 > n // 2 else 0)
            rows.append((f, node, parent, 1 if k == 1 else 2, float(k * 97 % 400), float(k * 61 % 250), float(k * 43 % 300), 11))
    return spark.createDataFrame(rows, "file_id string, node_id int, parent_id int, type int, x double, y double, z double, region_id int")


def volume(spark):
    cells = [(a, b, c, 11 if b < 5 else 12) for a in range(16) for b in range(10) for c in range(12) if (a, b) != (15, 9)]
    return spark.createDataFrame(cells, "ai int, bi int, ci int, region_id int")


def test_portions_are_folded_before_they_move(spark):
    rows = P.tree_rows(tree(spark), volume(spark), GRID)
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(rows))
    assert moved and not [m for m in moved if "voxel" in m]


def test_a_file_is_folded_in_one_task_however_many_there_are(spark):
    # dealt by node, every task would see some of every file, and the folded rows that move would grow with files times tasks
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        text = plan(P.tree_rows(tree(spark), volume(spark), GRID))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    dealt = re.search(r"Exchange hashpartitioning\(([^\n]*), 4\)", text[text.index("Generate"):])[1]
    keys = re.sub(r"FLOOR\(.*\)", "group", dealt)
    assert re.fullmatch(r"file_id#\d+, (group|_group#\d+L?)", keys), keys


def test_a_node_moves_once_to_meet_its_parent(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        text = plan(P.tree_rows(tree(spark), volume(spark), GRID))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # one exchange of nodes and one of folded rows
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2 and "SortMergeJoin" not in text


def test_families_are_the_rows_of_a_join(spark):
    rows = [
        ("a", 1, -1, 1), ("a", 2, 1, 2), ("a", 2, 1, 3), ("a", 3, 2, None), ("a", 70_000, 2, 2), ("a", 70_000, 3, 2), ("a", 70_001, 70_000, 2),
        ("a", 4, 99, 2), ("a", 5, None, 2), ("a", None, 1, 2), ("a", None, 200_000, 2), ("a", 6, 6, 2), ("a", -3, 1, 2), ("a", 9, -3, 2),
        ("b", 1, -1, 1), ("b", 1, -1, 1), ("c", 70_000, 1, 2), (None, 1, -1, 1), (None, 2, 1, 2), (None, None, None, None),
        *[("star", k, -1 if k == 1 else 1, 2) for k in range(1, 300)],
    ]
    rows = [(*r, float(k), float(k % 7) if k % 5 else None, 1.5, k % 3) for k, r in enumerate(rows)]
    nodes = spark.createDataFrame(rows, "file_id string, node_id int, parent_id int, type int, x double, y double, z double, region_id int")
    got = P._families(nodes)
    parent = nodes.select("file_id", "node_id", F.col("type").alias("own_type"), F.col("region_id").alias("own_region"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    child = nodes.filter("parent_id <> -1").select("file_id", F.col("parent_id").alias("node_id"), "type", *[F.col(c).alias(f"{c}1") for c in "xyz"])
    want = parent.join(child, ["file_id", "node_id"], "left").select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_profile_rows_agree_with_a_large_volume(spark, monkeypatch):
    nodes, cells = tree(spark), volume(spark)
    keys = ["file_id", "region_id", "side", "compartment"]
    read = lambda: {tuple(r[k] for k in keys): (round(r["cable"], 6), r["termini"]) for r in P.tree_rows(nodes, cells, GRID).collect()}
    small = read()
    monkeypatch.setattr(P.joins, "fits_broadcast", lambda *a, **k: False)
    assert small == read() and sum(v[1] for v in small.values()) == 2 + 39


def test_vectors_are_sent_to_few_blocks():
    from arborlake.operators import pairs as PP

    # copies of a vector: one per block, in proportion to the files up to the bound of a tile
    assert [-(-n // PP.block_files(n)) for n in (100, 5_000, 60_000)] == [1, 10, 16] and PP.block_files(10**7) == PP.MOST_FILES


def test_tiles_leave_in_strips(spark, monkeypatch):
    from arborlake.operators import clustering as K, pairs as PP

    monkeypatch.setattr(PP, "STRIP_PAIRS", 8)
    monkeypatch.setattr(K, "POINTS_PER_BLOCK", 4)
    rows = [(f"n{k}", float(k % 5), None if k == 3 else float(k), 0.5) for k in range(11)] + [(None, 0.0, 0.0, 0.0)]
    got = {(r["i"], r["j"]): r["distance"] for r in K.soma_distances(spark.createDataFrame(rows, "file_id string, x double, y double, z double")).collect()}
    want = {}
    for a, b in [(a, b) for a in rows for b in rows if a[0] and b[0] and a[0] < b[0]]:
        want[a[0], b[0]] = None if None in a + b else ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
    assert got == want
    vectors = [(f"n{k}", f"v{v}", float(k + v)) for k in range(9) for v in range(k % 4)] + [(None, "v0", 1.0)]
    frame = spark.createDataFrame(vectors, "file_id string, key string, value double")
    found = {(r["i"], r["j"]): r["sxy"] for r in PP.pair_products(frame, block_size=3, strip_size=2).collect()}
    dense = {f: {k: x for g, k, x in vectors if g == f} for f in {v[0] for v in vectors if v[0]}}
    sums = {(a, b): sum(x * dense[b].get(k, 0.0) for k, x in dense[a].items()) for a in dense for b in dense if a < b}
    assert {p: s for p, s in found.items() if s} == {p: s for p, s in sums.items() if s}


def test_single_linkage_moves_no_pair(spark, monkeypatch):
    import itertools

    import numpy as np

    from arborlake.operators import clustering as K, linkage as L

    rng = np.random.default_rng(3)
    d = {(i, j): float(rng.integers(1, 30)) for i, j in itertools.combinations(range(50), 2)}  # with many equal lengths
    rows = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", w) for (i, j), w in d.items()], "i string, j string, distance double")
    ids = spark.createDataFrame([(f"n{k:02d}",) for k in range(50)], "file_id string")
    monkeypatch.setattr(K, "matrix_rows", lambda *a: pytest.fail("a matrix is written"))
    lead, want = list(range(50)), []

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for w, i, j in sorted((w, i, j) for (i, j), w in d.items()):
        if root(i) != root(j):
            lead[root(i)] = root(j)
            want.append((w, i, j))
    numbers = spark.createDataFrame([(i, j, w) for (i, j), w in d.items()], "a long, b long, d double").repartition(5)
    for most in (1, 60, 1 << 21):
        assert [tuple(r) for r in L.pair_tree(numbers, 50, most).tolist()] == want
    tree = K.hierarchical(rows, ids, "single")
    assert sorted(r["height"] for r in tree.merges.collect()) == [w for w, _, _ in want]
    with pytest.raises(ValueError, match="lacks pairs"):
        L.pair_tree(numbers.filter("a <> 7 AND b <> 7"), 50)


def test_ward_of_points_writes_no_pair(spark, monkeypatch):
    import numpy as np

    from arborlake.operators import clustering as K, linkage as L

    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(size=(50, 3)) * 40, np.repeat(rng.integers(0, 9, (4, 3)), 5, axis=0), [[1.0, 2.0, 3.0]] * 3])
    points = points[rng.permutation(len(points))]
    rows = spark.createDataFrame([(f"n{k:02d}", *map(float, p)) for k, p in enumerate(points)], "file_id string, x double, y double, z double")
    ids = rows.select("file_id")
    # one merge at a time: the nearest pair, of equal ones that of the smaller first and then the smaller second member
    groups, want = [[k] for k in range(len(points))], []
    while len(groups) > 1:
        gap = lambda a, b: round(2 * len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(0) - points[b].mean(0)) ** 2).sum(), 9)
        h, i, j = min((gap(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        want.append((f"n{groups[i][0]:02d}", f"n{groups[j][0]:02d}", round(h ** 0.5, 6), len(groups[i]) + len(groups[j])))
        groups[i] += groups.pop(j)
    read = lambda tree: sorted((r["left_id"], r["right_id"], round(r["height"], 6), r["size"]) for r in tree.merges.collect())
    plain = K.soma_distances(rows)
    copied = plain.select("*")  # a frame that does not know its points takes the matrix
    assert read(K.hierarchical(copied, ids, "ward")) == sorted(want)
    monkeypatch.setattr(K, "matrix_rows", lambda *a: pytest.fail("a matrix is written"))
    for last, cells in ((512, 1 << 26), (9, 200), (1, 1 << 26)):
        monkeypatch.setattr(L, "TASK_CELLS", cells)
        assert read(K.hierarchical(plain, ids, "ward", last=last)) == sorted(want)


def test_average_linkage_of_correlations_writes_no_pair(spark, monkeypatch):
    import numpy as np

    from arborlake.operators import clustering as K, linkage as L
    from arborlake.operators.pearson import pearson

    rng = np.random.default_rng(11)
    c = rng.integers(0, 4, (70, 23)) * (rng.random((70, 23)) < 0.5)
    c[[5, 31, 47]], c[[8, 60]] = c[2], c[40]  # equal vectors
    rows = [(f"n{f:02d}", int(v), int(c[f, v])) for f, v in zip(*np.nonzero(c))] + [(None, 3, 2), ("flat", 0, 0)]
    found = pearson(spark.createDataFrame(rows, "file_id string, voxel long, c long"))
    ids = found.ids.filter("file_id IS NOT NULL")
    r = {(p["i"], p["j"]): 1 - p["r"] for p in found.pairs.collect()}
    names = sorted(x[0] for x in ids.collect())
    apart = np.array([[r.get((min(a, b), max(a, b)), 0.0) for b in names] for a in names])
    groups, want = [[k] for k in range(len(names))], []
    while len(groups) > 1:
        h, i, j = min((round(apart[np.ix_(groups[i], groups[j])].mean(), 9), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        want.append((names[groups[i][0]], names[groups[j][0]], round(h, 6) + 0.0, len(groups[i]) + len(groups[j])))
        groups[i] += groups.pop(j)
    read = lambda tree: sorted((r["left_id"], r["right_id"], round(r["height"], 6) + 0.0, r["size"]) for r in tree.merges.collect())
    assert len(names) == 70 and read(K.hierarchical(found.distances().select("*"), ids, "average")) == sorted(want)  # by the matrix
    monkeypatch.setattr(K, "matrix_rows", lambda *a: pytest.fail("a matrix is written"))
    for last, cells, strip in ((512, 1 << 23, 4096), (9, 200, 5)):
        monkeypatch.setattr(L, "BLOCK_CELLS", cells)
        monkeypatch.setattr(L, "KEYS_PER_STRIP", strip)
        assert read(K.hierarchical(found.distances(), ids, "average", last=last)) == sorted(want)


def test_names_of_regions_move_no_node(spark):
    from arborlake.bridge import Tables

    rows = Tables(spark, "/root/testdata/sf0.001").named_nodes.groupBy("region_name").agg(F.count("*").alias("n"))
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(rows))
    assert moved and not [m for m in moved if "region_id" in m]


def test_rank_correlation_of_trees_makes_no_row_per_pair(spark, monkeypatch):
    import itertools

    import numpy as np

    from arborlake.operators import clustering as K

    rng = np.random.default_rng(5)
    names = [f"n{k:02d}" for k in range(41)]

    def tree(of):
        d = [(i, j, float(rng.integers(1, 25))) for i, j in itertools.combinations(of, 2)]
        ids = spark.createDataFrame([(i,) for i in of], "file_id string")
        return K.hierarchical(spark.createDataFrame(d, "i string, j string, distance double"), ids, "single")

    one, two = tree(names[:38]), tree(names[3:])  # some files stand in one tree alone
    heights = [{(r["i"], r["j"]): r["height"] for r in K.cophenetic(t).collect()} for t in (one, two)]
    both = sorted(set(heights[0]) & set(heights[1]))
    rank = lambda v: np.array([(np.asarray(v) < x).sum() + ((np.asarray(v) == x).sum() + 1) / 2 for x in v])
    want = np.corrcoef(*[rank([h[p] for p in both]) for h in heights])[0, 1]
    monkeypatch.setattr(K, "cophenetic", lambda tree: pytest.fail("a row per pair is made"))
    for reach, points in ((4, 2), (1 << 14, 1024)):
        monkeypatch.setattr(K, "REACH", reach)
        monkeypatch.setattr(K, "POINTS_PER_BLOCK", points)
        got = K.cophenetic_spearman(one, two).first()
        assert got["pairs"] == len(both) and got["spearman"] == pytest.approx(want, abs=1e-9)
