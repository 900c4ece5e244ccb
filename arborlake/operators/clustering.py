"""Clustering of somas and of distance tables."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranks import number_rows, running_before
from ..model import finite
from ..session import forget, lookup_join, settle, union_all
from .components import connected_components
from .linkage import (
    BLOCK_CELLS, LAST_CLUSTERS, LINKAGES, count_distances, linkage, matrix_rows, pair_tree, point_distances, single_merges, tile_tree,
    vector_merges, ward_merges,
)
from .pairs import STRIP_PAIRS, all_pairs, block_files, block_pairs, tiles, with_block

BLOCK = 512
#: Points of a block: a pair of blocks is one tile of distances, and enough tiles are made to keep all tasks busy.
POINTS_PER_BLOCK = 1024
#: Leaves of a block whose highest gaps are found together, a power of two.
REACH = 1 << 14


def soma_distances(coords: DataFrame, dims: Sequence[str] = "xyz", n: int | None = None) -> DataFrame:
    """(i, j, distance): Euclidean distance of every pair of somas.

    The frame remembers its points, for what follows from them without the pairs (``hierarchical``).
    """
    points = coords.filter("file_id IS NOT NULL").select("file_id", *[F.col(d).cast("double").alias(d) for d in dims])
    size = points.count() if n is None else n
    blocks = max(1, math.ceil(size / POINTS_PER_BLOCK))
    void = F.lit(False)
    for d in dims:
        void = void | F.col(d).isNull()
    sent = block_pairs(with_block(points.withColumn("_null", void), blocks), blocks)

    def load(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(d).to_numpy() for d in dims], axis=1)

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros((len(a), len(b)))
        for k in range(len(dims)):
            total += (a[:, None, k] - b[None, :, k]) ** 2
        return np.sqrt(total)

    out = tiles(sent, ["bi", "bj"], load, apart, "distance")
    out._points = points
    return out


def soma_kmeans(coords: DataFrame, k: int = 5, seed: int = 42, starts: int = 10, dims: Sequence[str] = "xyz") -> DataFrame:
    """(file_id, label): k-means with labels from 1; the cheapest of several seeded starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = settle(VectorAssembler(inputCols=list(dims), outputCol="features").transform(coords))
    models = [KMeans(k=k, seed=seed + i, maxIter=300, tol=1e-4).fit(points) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(points).select("file_id", (F.col("prediction") + 1).alias("label"))


# --- agglomeration

@dataclass(frozen=True)
class Tree:
    """A dendrogram: one row per merge with its node, child nodes, height and sizes; ``ids`` are the leaves.

    A cluster is named by its smallest member; that side is the left one.
    """

    merges: DataFrame
    ids: DataFrame
    size: int

    @cached_property
    def starts(self) -> DataFrame:
        """(node, start): leaves in front of each node, summed along the path to the root by pointer doubling."""
        left = self.merges.select(F.col("left_node").alias("node"), F.col("node").alias("up"), F.lit(0).cast("long").alias("start"))
        right = self.merges.select(F.col("right_node").alias("node"), F.col("node").alias("up"), F.col("left_size").cast("long").alias("start"))
        children = left.unionByName(right)
        every = self.ids.select(F.col("file_id").alias("node")).unionByName(self.merges.select("node"))
        root = every.join(children.select("node"), "node", "left_anti").select(
            "node", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("start")
        )
        state = settle(children.unionByName(root))
        while state.filter("up IS NOT NULL").limit(1).count():
            table = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("start").alias("_start"))
            moved = lookup_join(state.filter("up IS NOT NULL"), table, "up", salt_by=["node"]).select(
                "node", F.col("_up").alias("up"), (F.col("start") + F.col("_start")).alias("start")
            )
            state = settle(state.filter("up IS NULL").unionByName(moved), replaces=state)
        return state.select("node", "start")

    @property
    def leaf_order(self) -> DataFrame:
        """(file_id, position) of the dendrogram, left to right."""
        return self.ids.join(self.starts.withColumnRenamed("node", "file_id"), "file_id").select(
            "file_id", F.col("start").alias("position")
        )

    @property
    def gaps(self) -> DataFrame:
        """(position, height …): the merge that joins each leaf with the next one."""
        rows = self.merges.join(self.starts, "node")
        return rows.select((F.col("start") + F.col("left_size") - 1).alias("position"), "height", "size", "left_id")

    def ordered_merges(self) -> DataFrame:
        """Merges numbered from 1 by height; of equal ones the smaller cluster, then the smaller first member."""
        return number_rows(self.merges, ["height", "size", "left_id"], "step", start=1)


def hierarchical(pairs: DataFrame, ids: DataFrame, method: str = "average", distance: str = "distance", last: int = LAST_CLUSTERS) -> Tree:
    """Agglomerate a complete pair table (i, j, distance).

    Ids become numbers in their order. Average, complete and ward write the pairs once as a matrix (``linkage``) and merge all
    reciprocal nearest clusters of a round at once, which gives the same tree as one merge at a time; single linkage takes the
    edges of a minimum spanning tree in order, folded from the pairs as they pass. Equal distances go to the smaller id. Ward of
    the frame of ``soma_distances`` takes its heights from the points, so that no pair is written (``ward_merges``), and the average of
    Pearson's ``distances`` takes them from the vectors (``vector_merges``). The spanning tree of both frames is folded from tiles of
    distances, so that no pair is a row (``tile_tree``).
    """
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method!r}")
    names = settle(number_rows(ids.select(F.col("file_id").cast("string").alias("file_id")), ["file_id"], "number"))
    n = names.count()
    points = _numbered_points(pairs, names, n) if method == "ward" and distance == "distance" else None
    if points is not None:
        return _tree(ward_merges(pairs.sparkSession, points, last), names, n)
    merges = _vector_merges(pairs, names, n, last) if method == "average" and distance == "distance" else None
    if merges is not None:
        return _tree(merges, names, n)
    tree = _tile_tree(pairs, names, n) if method == "single" and distance == "distance" else None
    if tree is not None:
        return _tree(single_merges(pairs.sparkSession, tree, n), names, n)
    rows = pairs.select("i", "j", F.col(distance).cast("double").alias("s"))
    for end, name in (("i", "r"), ("j", "c")):
        rows = lookup_join(rows, names.select(F.col("file_id").alias(end), F.col("number").alias(name)), end, salt_by=["i", "j"])
    if method == "single":
        ends = rows.select(F.least("r", "c").alias("a"), F.greatest("r", "c").alias("b"), F.col("s").alias("d"))
        return _tree(single_merges(pairs.sparkSession, pair_tree(ends, n), n), names, n)
    value = F.col("s") * F.col("s") if method == "ward" else F.col("s")
    both = F.array(F.struct(F.col("r").alias("r"), F.col("c").alias("c")), F.struct(F.col("c").alias("r"), F.col("r").alias("c")))
    matrix = matrix_rows(rows.select(F.explode(both).alias("p"), value.alias("s")).select("p.r", "p.c", "s"), n)
    tree = _tree(linkage(matrix, n, method, last), names, n)
    forget(matrix)
    return tree


def _numbered_points(pairs: DataFrame, names: DataFrame, n: int) -> np.ndarray | None:
    """Coordinates of the files in the order of their numbers; None where the pairs are not those of one finite point per file."""
    points = pairs.__dict__.get("_points")
    if points is None:
        return None
    dims = [c for c in points.columns if c != "file_id"]
    found = names.join(points.withColumn("file_id", F.col("file_id").cast("string")), "file_id").select("number", *dims).toArrow()
    number, rows = found.column("number").to_numpy(), np.stack([found.column(d).to_numpy().astype(float) for d in dims], axis=1)
    if not np.array_equal(np.sort(number), np.arange(n)) or names.select("file_id").distinct().count() < n or not np.isfinite(rows).all():
        return None
    return rows[np.argsort(number)]


def _vector_merges(pairs: DataFrame, names: DataFrame, n: int, last: int) -> DataFrame | None:
    """Average linkage from the vectors of the files; None where the pairs are not those of one finite vector per file."""
    vectors = pairs.__dict__.get("_vectors")
    if vectors is None:
        return None
    rows = settle(names.join(vectors.withColumn("file_id", F.col("file_id").cast("string")), "file_id").drop("file_id"))
    found = rows.select("number", "shift", "mark", "mark2", F.size("keys").cast("long").alias("cells")).toArrow().sort_by("number")
    number, shift, *marks, cells = (found.column(c).to_numpy() for c in ("number", "shift", "mark", "mark2", "cells"))
    whole = np.array_equal(number, np.arange(n)) and names.select("file_id").distinct().count() == n and np.isfinite(shift).all()
    merges = vector_merges(rows, shift, np.stack(marks, axis=1), int(cells.sum()), last) if whole else None
    forget(rows)
    return merges


def _tile_tree(pairs: DataFrame, names: DataFrame, n: int) -> np.ndarray | None:
    """The minimum spanning tree from points or counted vectors; None where the pairs are not those of one finite one per file."""
    points, counted = pairs.__dict__.get("_points"), pairs.__dict__.get("_counts")
    if n < 2 or points is None and counted is None:
        return None
    own, v = (points, 0.0) if counted is None else counted
    rows = settle(names.join(own.withColumn("file_id", F.col("file_id").cast("string")), "file_id").drop("file_id"))
    values = ["sx", "var"] if counted is not None else [c for c in points.columns if c != "file_id"]
    sound = F.lit(True)
    for c in values:
        sound = sound & finite(c)
    size = F.size("keys").cast("long") if counted is not None else F.lit(0).cast("long")
    found = rows.agg(F.count_if(sound).alias("sound"), F.count_distinct("number").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(size).alias("cells")).first()
    tree = None
    if found["sound"] == found["rows"] == found["n"] == n == names.select("file_id").distinct().count():
        each = min(block_files(n), max(BLOCK_CELLS // max(found["cells"] // n, 1), 1))
        measure = (lambda a, b: point_distances(a, b, values)) if counted is None else (lambda a, b: count_distances(a, b, v))
        tree = tile_tree(rows, n, each, measure)
    forget(rows)
    return tree


def _tree(merges: DataFrame, names: DataFrame, n: int) -> Tree:
    """The merges of numbers as a tree of named files."""
    for side in ("left", "right"):
        table = names.select(F.col("number").alias(f"{side}_number"), F.col("file_id").alias(f"{side}_id"))
        merges = lookup_join(merges, table, f"{side}_number", salt_by=["step"])
    named = lambda step, own: F.when(step < 0, F.col(own)).otherwise(F.concat(step.cast("string"), F.lit(":"), F.col(own)))
    return Tree(settle(merges.select(
        named(F.col("step"), "left_id").alias("node"), named(F.col("left_step"), "left_id").alias("left_node"),
        named(F.col("right_step"), "right_id").alias("right_node"), "left_id", "right_id", "height", "size", "left_size",
    )), settle(names.select("file_id")), n)


def leaf_order(tree: Tree) -> DataFrame:
    return tree.leaf_order


def _cut_heights(tree: Tree, k: int, exact: bool) -> DataFrame:
    """Gap positions where the order is cut into clusters."""
    gaps = tree.gaps
    if exact:
        return gaps.orderBy(F.desc("height"), F.desc("size"), F.desc("left_id")).limit(k - 1).select("position")
    if k >= tree.size:
        return gaps.select("position")
    threshold = gaps.orderBy(F.desc("height")).limit(k).agg(F.min("height")).scalar()
    return gaps.filter(F.col("height") > threshold).select("position")


def cut_clusters(tree: Tree, k: int, exact: bool = False) -> DataFrame:
    """(file_id, label): at most k clusters with equal heights kept together, or exactly k.

    In leaf order a cluster is a run between cut gaps, so labels are a running count; they are then numbered by
    their smallest member.
    """
    if k < 1:
        raise ValueError("k must be positive")
    cuts = _cut_heights(tree, k, exact).select((F.col("position") + 1).alias("position"), F.lit(1).cast("long").alias("opens"))
    rows = tree.leaf_order.join(cuts, "position", "left").withColumn("opens", F.coalesce("opens", F.lit(0).cast("long")))
    runs = running_before(rows, ["position"], "opens", "before").select("file_id", (F.col("before") + F.col("opens")).alias("run"))
    return number_groups(runs, "run")


def number_groups(rows: DataFrame, group: str, start: int = 1) -> DataFrame:
    """(file_id, label): groups numbered by their smallest file."""
    first = rows.groupBy(group).agg(F.min("file_id").alias("_first"))
    numbers = number_rows(first, ["_first"], "label", start).select(group, F.col("label").cast("int").alias("label"))
    return lookup_join(rows, numbers, group, salt_by=["file_id"]).select("file_id", "label")


def labels_for_ks(tree: Tree, ks: Sequence[int]) -> DataFrame:
    """(k, file_id, label) for many small k in one pass over the leaves; labels are run numbers."""
    top = tree.gaps.orderBy(F.desc("height")).limit(max(ks) + 1).collect()
    # all gaps higher than the k-th highest one are among the highest k - 1
    rows = []
    for k in ks:
        threshold = top[k - 1]["height"] if k <= len(top) else -math.inf
        rows.append((k, sorted(r["position"] for r in top if r["height"] > threshold)))
    cuts = F.array(*[
        F.struct(F.lit(k).alias("k"), F.array(*[F.lit(p) for p in cut]).cast("array<long>").alias("cut")) for k, cut in rows
    ])
    spread = tree.leaf_order.select("file_id", "position", F.explode(cuts).alias("c"))
    label = F.size(F.filter("c.cut", lambda p: p < F.col("position")))
    return spread.select(F.col("c.k").alias("k"), "file_id", label.alias("label"))


def range_maxima(tops: DataFrame, n: int) -> DataFrame:
    """(level, block, top): the maximum of 2^level blocks from ``block`` on, for all runs that end inside; ``tops`` has (block, top)."""
    level, rows = 0, settle(tops.select(F.lit(0).alias("level"), "block", "top"))
    levels = [rows]
    while 2 << level <= n:
        after = rows.select((F.col("block") - (1 << level)).cast("int").alias("block"), F.col("top").alias("_top"))
        rows = settle(rows.join(after, "block").select(F.lit(level + 1).alias("level"), "block", F.greatest("top", "_top").alias("top")))
        level += 1
        levels.append(rows)
    return settle(union_all(levels))


def cophenetic(tree: Tree) -> DataFrame:
    """(i, j, height): the merge that first joins each pair of leaves.

    In leaf order it is the highest gap between the two. Leaves form blocks of consecutive positions: a pair in one
    block reads the block's own gaps, a pair of two blocks the end of one, the start of the other and the highest
    block between.
    """
    gaps = tree.gaps.select("position", "height")
    rows = tree.leaf_order.join(gaps, "position", "left").withColumn("block", F.floor(F.col("position") / F.lit(BLOCK)).cast("int"))
    cells = F.sort_array(F.collect_list(F.struct("position", "file_id", "height")))
    blocks = settle(rows.groupBy("block").agg(cells.alias("c")).select(
        "block", F.col("c.file_id").alias("ids"), F.transform("c.height", lambda h: F.coalesce(h, F.lit(0.0))).alias("gap")))
    at = blocks.select("block", "ids", "gap", F.posexplode("ids").alias("p", "file_id"))
    size = F.size("ids")
    inner = at.filter(F.col("p") < size - 1).select("*", F.explode(F.sequence(F.col("p") + 1, size - 1)).alias("q")).select(
        F.col("file_id").alias("x"), F.element_at("ids", F.col("q") + 1).alias("y"),
        F.array_max(F.slice("gap", F.col("p") + 1, F.col("q") - F.col("p"))).alias("height"),
    ).select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "height")
    n_blocks = max(1, math.ceil(tree.size / BLOCK))
    if n_blocks == 1:
        return inner
    ends = at.select(
        "file_id", "block", F.col("block").alias("blk"), F.array_max(F.slice("gap", F.col("p") + 1, size - F.col("p"))).alias("suffix"),
        F.coalesce(F.array_max(F.expr("slice(gap, 1, p)")), F.lit(0.0)).alias("prefix"),
    )
    pairs = all_pairs(ends, n_blocks * BLOCK, BLOCK).filter("blk_i <> blk_j")
    low_first = F.col("blk_i") < F.col("blk_j")
    low, high = F.least("blk_i", "blk_j"), F.greatest("blk_i", "blk_j")
    # the blocks between are covered by two runs whose length is a power of two
    index = range_maxima(blocks.select("block", F.array_max("gap").alias("top")), n_blocks)
    level = F.when(high - low > 1, F.floor(F.log2((high - low - 1).cast("double"))).cast("int"))
    pairs = pairs.withColumns({"level": level, "_low": low + 1, "_high": high - F.call_function("shiftleft", F.lit(1), F.coalesce(level, F.lit(0)))})
    for end in ("_low", "_high"):
        table = index.select("level", F.col("block").alias(end), F.col("top").alias(f"_top{end}"))
        pairs = lookup_join(pairs, table, ["level", end], "left", salt_by=["i", "j"])
    between = F.coalesce(F.greatest("_top_low", "_top_high"), F.lit(0.0))
    height = F.greatest(
        F.when(low_first, F.col("suffix_i")).otherwise(F.col("suffix_j")),
        F.when(low_first, F.col("prefix_j")).otherwise(F.col("prefix_i")), between,
    )
    return inner.unionByName(pairs.select("i", "j", height.alias("height")))


def range_rows(gaps: DataFrame, n: int) -> DataFrame:
    """(position, tops) of leaves 0 to n - 1, of (position, value): the gap after each leaf, null after the last.

    Positions p < q first differ, from the top, in bit k; the highest gap between the two is the greater of ``tops[k]`` of both.
    So two rows answer for their pair alone. Blocks of ``REACH`` leaves are worked off apart, and of each only the highest gap,
    one number for ``REACH`` leaves, is known to the others.
    """
    width, low = REACH, REACH.bit_length() - 1
    levels = max((n - 1).bit_length(), 1)
    rows = gaps.select("position", F.col("value").cast("double").alias("value"), F.shiftright("position", low).alias("block"))
    tops = np.full(max(-(-n // REACH), 1), -np.inf)
    for r in rows.groupBy("block").agg(F.max("value").alias("top")).toLocalIterator():
        tops[r["block"]] = -np.inf if r["top"] is None else r["top"]

    def reach(part: pa.Table) -> pa.Table:
        at, block = part.column("position").to_numpy(), part.column("block")[0].as_py()
        gap = np.full(width, -np.inf)
        gap[at - block * width] = pc.fill_null(part.column("value"), -np.inf).to_numpy()
        after = lambda g: np.maximum.accumulate(g[..., ::-1], axis=-1)[..., ::-1]
        before = lambda g: np.concatenate([np.full((*g.shape[:-1], 1), -np.inf), np.maximum.accumulate(g, axis=-1)[..., :-1]], axis=-1)
        out = np.empty((width, levels))
        for k in range(levels):
            if k < low:
                halves = gap.reshape(-1, 2, 1 << k)
                out[:, k] = np.stack([after(halves[:, 0]), before(halves[:, 1])], axis=1).ravel()
            else:
                first = block >> k - low << k - low
                if block >> k - low & 1:
                    out[:, k] = np.maximum(before(gap), tops[first: block].max(initial=-np.inf))
                else:
                    out[:, k] = np.maximum(after(gap), tops[block + 1: first + (1 << k - low)].max(initial=-np.inf))
        found = out[at - block * width]
        offsets = pa.array(np.arange(len(at) + 1) * levels, pa.int32())
        return pa.table({"position": part.column("position"), "tops": pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))})

    return rows.groupBy("block").applyInArrow(reach, "position long, tops array<double>")


def _ranked_leaves(tree: Tree, common: DataFrame, prefix: str) -> DataFrame:
    """(file_id, position, tops) of the common leaves: ``range_rows`` of the mean ranks of heights over all pairs of common leaves.

    A merge joins as many pairs as the product of its sides, so ranks come from the merges. A height that lies below one inside,
    as rounding can leave it, counts as that one. Ranks are taken from their mean.
    """
    merges = settle(tree.merges.join(tree.starts, "node").select(
        F.col("start").alias("first"), (F.col("start") + F.col("left_size")).alias("second"), (F.col("start") + F.col("size")).alias("end"), "height"))
    order = settle(tree.leaf_order)
    codes = number_rows(merges.select("height").distinct(), ["height"], "code")
    coded = settle(merges.join(codes, merges["height"].eqNullSafe(codes["height"])).select("first", "second", "end", F.col("code").cast("double").alias("code")))

    def reached(rows: DataFrame, value: str) -> DataFrame:
        gaps = rows.select((F.col("second") - 1).alias("position"), F.col(value).alias("value"))
        return range_rows(order.select("position").join(gaps, "position", "left"), tree.size)

    tops = settle(reached(coded, "code"))
    level = F.length(F.bin(F.col("first").bitwiseXOR(F.col("end") - 1)))
    one = tops.select(F.col("position").alias("first"), F.col("tops").alias("_first"))
    two = tops.select((F.col("position") + 1).alias("end"), F.col("tops").alias("_end"))
    whole = coded.join(one, "first").join(two, "end").select("first", "second", "end", F.greatest(F.element_at("_first", level), F.element_at("_end", level)).alias("code"))
    flagged = order.join(common.withColumn("in", F.lit(1).cast("long")), "file_id", "left").withColumn("in", F.coalesce("in", F.lit(0).cast("long")))
    n = flagged.agg(F.coalesce(F.sum("in"), F.lit(0))).first()[0]
    earlier = settle(running_before(flagged.select("position", "in"), ["position"], "in", "before").select("position", "before"))
    for end in ("first", "second", "end"):
        whole = whole.join(earlier.select(F.col("position").alias(end), F.col("before").alias(f"n_{end}")), end, "left")
    held = settle(whole.withColumn("pairs", (F.col("n_second") - F.col("n_first")) * (F.coalesce("n_end", F.lit(n)) - F.col("n_second"))))
    before = running_before(held.groupBy("code").agg(F.sum("pairs").alias("pairs")), ["code"], "pairs", "before")
    mean = (n * (n - 1) // 2 + 1) / 2.0
    ranks = before.select("code", (F.col("before") + (F.col("pairs") + 1) / F.lit(2.0) - F.lit(mean)).alias("rank"))
    found = reached(held.join(ranks, "code"), "rank").withColumnRenamed("tops", f"{prefix}tops")
    return order.join(common, "file_id", "left_semi").join(found, "position").withColumnRenamed("position", f"{prefix}position")


def _rank_products(table: pa.Table) -> pa.Table:
    """Sums of products of both ranks over the pairs of one tile, in strips."""
    own = {c: table.column(c).to_numpy() for c in ("block", "bi", "bj")}
    left, right = np.flatnonzero(own["block"] == own["bi"]), np.flatnonzero(own["block"] == own["bj"])
    trees = []
    for prefix in "xy":
        tops = pa.concat_arrays(table.column(f"{prefix}tops").chunks).flatten().to_numpy().reshape(table.num_rows, -1)
        trees.append((table.column(f"{prefix}position").to_numpy(), tops))
    total, n, step = np.zeros(3), 0, max(STRIP_PAIRS // max(len(right), 1), 1)
    for start in range(0, len(left), step):
        part, ranks = left[start: start + step], []
        keep = part[:, None] < right[None, :] if own["bi"][0] == own["bj"][0] else np.ones((len(part), len(right)), bool)
        a, b = np.nonzero(keep)
        a, b = part[a], right[b]
        for position, tops in trees:
            level = np.frexp((position[a] ^ position[b]).astype(float))[1] - 1
            ranks.append(np.maximum(tops[a, level], tops[b, level]))
        x, y = ranks
        total, n = total + [x @ x, y @ y, x @ y], n + len(a)
    return pa.table({"n": pa.array([n], pa.int64()), **{c: pa.array([float(v)]) for c, v in zip(("xx", "yy", "xy"), total)}})


def cophenetic_spearman(first: Tree, second: Tree) -> DataFrame:
    """One row: rank correlation of the two trees' merge heights over all pairs of files that both hold.

    No pair is a row: tiles of files with their ``range_rows`` in both trees are summed where they meet.
    """
    common = settle(first.ids.select("file_id").join(second.ids.select("file_id"), "file_id").distinct())
    rows = settle(_ranked_leaves(first, common, "x").join(_ranked_leaves(second, common, "y"), "file_id"))
    blocks = max(1, math.ceil(rows.count() / POINTS_PER_BLOCK / 4))
    sums = block_pairs(with_block(rows, blocks), blocks).groupBy("bi", "bj").applyInArrow(_rank_products, "n long, xx double, yy double, xy double")
    sums = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), *[F.sum(c).alias(c) for c in ("xx", "yy", "xy")])
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(F.when(spread > 0, F.col("xy") / spread).alias("spearman"), "pairs")


def ordered_distances(pairs: DataFrame, tree: Tree, labels: DataFrame, distance: str = "distance") -> DataFrame:
    """Distance cells by leaf position with both labels; each unordered pair once, plus the diagonal."""
    order = tree.leaf_order.join(labels, "file_id")
    own = order.select(F.col("file_id").alias("i"), F.col("file_id").alias("j"), F.lit(0.0).alias(distance))
    rows = pairs.select("i", "j", distance).unionByName(own)
    for side, name in (("i", "row"), ("j", "column")):
        table = order.select(F.col("file_id").alias(side), F.col("position").alias(name), F.col("label").alias(f"{name}_label"))
        rows = lookup_join(rows, table, side, salt_by=["i", "j"])
    return rows


# --- density clusters

SHRINK = 0.999999
TILE = 1024


def _cells(points: DataFrame, dims: Sequence[str], side: float, prefix: str) -> DataFrame:
    return points.withColumns({f"{prefix}{i}": F.floor(F.col(d) / F.lit(side)) for i, d in enumerate(dims)})


def _gap2(dims: int, a: str, b: str, far: bool) -> Column:
    """Squared smallest or largest distance of two boxes given by lo/hi columns."""
    total = F.lit(0.0)
    for i in range(dims):
        lo_a, hi_a, lo_b, hi_b = (F.col(f"{s}.{e}{i}") for s in (a, b) for e in ("lo", "hi"))
        if far:
            step = F.greatest(F.abs(hi_a - lo_b), F.abs(hi_b - lo_a))
        else:
            step = F.greatest(lo_a - hi_b, lo_b - hi_a, F.lit(0.0))
        total = total + step * step
    return total


def _boxes(points: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    sides = [f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return points.groupBy(*keys).agg(*sides, F.count(F.lit(1)).alias("n"))


def _near_tile(dims: Sequence[str], eps: float):
    """Is any point of side a within eps of any point of side b?"""

    def look(group: pd.DataFrame) -> pd.DataFrame:
        mine = group["is_a"].to_numpy()
        xyz = group[list(dims)].to_numpy()
        a, b = xyz[mine], xyz[~mine]
        hit = len(a) and len(b) and bool((((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) <= eps * eps).any())
        return pd.DataFrame({c: [group[c].iloc[0]] if hit else [] for c in ("src", "dst")}, dtype=object)

    return look


def _dense_links(points: DataFrame, dims: Sequence[str], side: float, eps: float) -> DataFrame:
    """Pairs of dense cells that hold two points within eps.

    Bounding boxes decide most pairs, first of cells, then of 4-fold finer parts; only parts that still straddle
    the radius are compared point by point, in tiles of bounded size.
    """
    n, keys = len(dims), [f"c{i}" for i in range(len(dims))]
    forward = [o for o in itertools.product(range(-2, 3), repeat=n) if o > (0,) * n]
    steps = F.array(*[F.array(*[F.lit(v) for v in o]) for o in forward])
    boxes = settle(_boxes(points, ["cell", *keys], dims))
    a = boxes.select(F.struct("*").alias("a"), F.explode(steps).alias("o")).select(
        "a", *[(F.col(f"a.{k}") + F.col("o")[i]).alias(k) for i, k in enumerate(keys)]
    )
    pairs = a.join(boxes.select(F.struct("*").alias("b"), *keys), keys)
    pairs = settle(pairs.filter(_gap2(n, "a", "b", False) <= eps * eps).select(
        F.col("a.cell").alias("src"), F.col("b.cell").alias("dst"), (_gap2(n, "a", "b", True) <= eps * eps).alias("sure")
    ))
    sure, open_pairs = pairs.filter("sure").select("src", "dst"), pairs.filter("NOT sure").select("src", "dst")
    finer = _cells(points, dims, side / 4, "f").withColumn("part", F.concat_ws(",", *[f"f{i}" for i in range(n)]))
    parts = settle(_boxes(finer, ["cell", "part"], dims))
    one = parts.select(F.col("cell").alias("src"), F.struct("*").alias("a"))
    two = parts.select(F.col("cell").alias("dst"), F.struct("*").alias("b"))
    fine = open_pairs.join(one, "src").join(two, "dst").filter(_gap2(n, "a", "b", False) <= eps * eps).select(
        "src", "dst", F.col("a.part").alias("pa"), F.col("a.n").alias("n_a"), F.col("b.part").alias("pb"), F.col("b.n").alias("n_b"),
        (_gap2(n, "a", "b", True) <= eps * eps).alias("sure"),
    )
    fine = settle(fine)
    decided = fine.filter("sure").select("src", "dst").distinct()
    rest = fine.filter("NOT sure").join(decided, ["src", "dst"], "left_anti")
    chunks = lambda c: F.ceil(F.col(c) / F.lit(TILE)).cast("int")
    tiles = rest.withColumn("ta", F.explode(F.sequence(F.lit(0), chunks("n_a") - 1))).withColumn(
        "tb", F.explode(F.sequence(F.lit(0), chunks("n_b") - 1)))
    # a point knows its tile before it meets the tiles of other parts, so it is copied once per tile it is compared with
    sized = lookup_join(finer, parts.select("cell", "part", F.col("n").alias("_n")), ["cell", "part"], salt_by=["file_id"], check=False)
    mine = sized.select("file_id", "cell", "part", *dims, F.pmod(F.xxhash64("file_id"), chunks("_n")).cast("int").alias("tile"))
    of = ["src", "dst", "pa", "pb", "ta", "tb"]
    side_a = mine.withColumnsRenamed({"cell": "src", "part": "pa", "tile": "ta"}).join(tiles, ["src", "pa", "ta"])
    side_b = mine.withColumnsRenamed({"cell": "dst", "part": "pb", "tile": "tb"}).join(tiles, ["dst", "pb", "tb"])
    both = side_a.select(*of, *dims, F.lit(True).alias("is_a")).unionByName(side_b.select(*of, *dims, F.lit(False).alias("is_a")))
    close = both.groupBy(*of).applyInPandas(_near_tile(list(dims), eps), "src string, dst string")
    return union_all([sure, decided, close.distinct()])


def soma_dbscan(coords: DataFrame, eps: float = 100.0, min_samples: int = 5, dims: Sequence[str] = "xyz") -> DataFrame:
    """(file_id, label): 1 for noise, clusters from 2 by smallest core member; borders go to the lowest cluster.

    Cells are small enough that all points of one are within eps. A cell with min_samples points is all core and
    one vertex of the cluster graph, so a crowded spot costs no pairs. Only points of sparse cells, fewer than
    min_samples each, are compared with the points around them: a point meets a bounded number of them.
    """
    n, dims = len(dims), list(dims)
    side = eps / math.sqrt(n) * SHRINK
    keys = [f"c{i}" for i in range(n)]
    points = _cells(coords.select("file_id", *[F.col(d).cast("double").alias(d) for d in dims]), dims, side, "c")
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    points = lookup_join(points, counts, keys, salt_by=["file_id"], check=False).withColumns({
        "dense": F.col("_n") >= min_samples, "cell": F.concat_ws(",", F.lit("cell"), *keys),
    })
    points = settle(points.drop("_n"))
    sparse = points.filter("NOT dense")
    offsets = list(itertools.product(range(-2, 3), repeat=n))
    steps = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])

    # cells around a sparse one that hold any point: a point goes to these alone
    occupied = points.select(*[F.col(k).alias(f"o{k}") for k in keys]).distinct()
    beside = sparse.select(*keys).distinct().select(*keys, F.explode(steps).alias("o")).select(*keys, *[(F.col(k) + F.col("o")[i]).alias(f"o{k}") for i, k in enumerate(keys)])
    beside = settle(beside.join(occupied, [f"o{k}" for k in keys], "left_semi"))

    def around(rows: DataFrame, others: DataFrame, *carry: str) -> DataFrame:
        """(p, …others) for sparse points p and the points within eps of them."""
        spread = rows.select(F.col("file_id").alias("p"), *[F.col(d).alias(f"p{d}") for d in dims], *keys).join(beside, keys)
        spread = spread.select("p", *[f"p{d}" for d in dims], *[F.col(f"o{k}").alias(k) for k in keys])
        met = lookup_join(others.select("file_id", *dims, *keys, *carry), spread, keys, salt_by=["file_id"])
        squares = [F.pow(F.col(d) - F.col(f"p{d}"), F.lit(2.0)) for d in dims]
        return met.filter(sum(squares[1:], squares[0]) <= F.lit(eps * eps)).select("p", "file_id", *carry)

    neighbours = around(sparse, points).groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    core_ids = settle(neighbours.filter(F.col("c") >= min_samples).select(F.col("p").alias("file_id")))
    sparse_core = sparse.join(core_ids, "file_id", "left_semi").withColumn("vertex", F.concat(F.lit("point,"), "file_id"))
    cores = settle(points.filter("dense").withColumn("vertex", F.col("cell")).unionByName(sparse_core))
    near = settle(around(sparse, cores, "vertex"))
    core_links = near.join(core_ids.withColumnRenamed("file_id", "p"), "p", "left_semi").select(
        F.concat(F.lit("point,"), "p").alias("src"), F.col("vertex").alias("dst")
    ).distinct()
    links = core_links.unionByName(_dense_links(points.filter("dense"), dims, side, eps))
    groups = connected_components(cores.select(F.col("vertex").alias("id")).distinct(), links)
    found = lookup_join(cores.select("file_id", "vertex"), groups.withColumnRenamed("id", "vertex"), "vertex", salt_by=["file_id"])
    numbered = settle(number_groups(found, "component", start=2))
    border = near.join(core_ids.withColumnRenamed("file_id", "p"), "p", "left_anti").join(numbered, "file_id").groupBy(
        F.col("p").alias("file_id")
    ).agg(F.min("label").alias("label"))
    labelled = numbered.unionByName(border)
    return points.select("file_id").join(labelled, "file_id", "left").select("file_id", F.coalesce("label", F.lit(1)).alias("label"))
