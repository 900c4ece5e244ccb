"""Agglomeration over a distance matrix that stays where it is.

The matrix is written once as rows of numbers, one row per cluster. A round reads it, folds the columns of clusters that have
merged since it was written, and yields the nearest cluster of every row whose answer may have changed; reciprocal nearest
clusters merge. What a round leaves behind is its merges and the list of nearest clusters, both as long as the number of
clusters, the root of the matrix. Only when the number of clusters has halved the matrix is written again, a quarter of its
size, so all writes together are less than one and a half matrices, however many rounds there are.

Two linkages need no matrix, since heights follow from sums over a cluster and its size: ward between points, and the average of
distances 1 - r, because a mean of products of vectors is the product of their means. Single linkage needs none either: a tile of
distances is folded to its spanning tree where it is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import forget, scratch_path, settle
from .pairs import KEYS_PER_STRIP, STRIP_PAIRS, block_files, block_pairs

LINKAGES = ("average", "ward", "complete", "single")
#: Cells that one task lays out as rows, clusters that are merged by one task, and merges that are sent at once.
STRIP_CELLS = 1 << 21
LAST_CLUSTERS = 512
#: Pairs that a task holds before it folds them to a spanning forest, and tasks that fold the forests of all others.
FOREST_PAIRS = 1 << 21
FOREST_TASKS = 16
#: Heights between clusters of points that one task works out.
TASK_CELLS = 1 << 26
#: Entries of the sparse vectors of a block of clusters.
BLOCK_CELLS = 1 << 23
MERGES = "step long, left_number long, right_number long, left_step long, right_step long, height double, size long, left_size long"


class Clusters:
    """The clusters over the columns of a written matrix: which cluster a column belongs to, sizes and inner spreads.

    A cluster is named by its smallest column. Sizes count members; the spread is ward's mean squared distance inside.
    """

    def __init__(self, method: str, size: np.ndarray, spread: np.ndarray):
        n = len(size)
        self.method, self.column_size = method, size
        self.owner, self.size, self.spread = np.arange(n), size.copy(), spread.copy()
        self.active = np.arange(n)

    def fold_columns(self, row: np.ndarray) -> np.ndarray:
        """A matrix row over columns as a row over the active clusters."""
        place = np.searchsorted(self.active, self.owner)
        if self.method in ("complete", "single"):
            out = np.full(len(self.active), -np.inf if self.method == "complete" else np.inf)
            (np.maximum if self.method == "complete" else np.minimum).at(out, place, row)
            return out
        return np.bincount(place, row * self.column_size, len(self.active)) / self.size[self.active]

    def fold_rows(self, rows: list[np.ndarray], weights: list[float]) -> tuple[np.ndarray, float]:
        if self.method in ("complete", "single"):
            return (np.maximum if self.method == "complete" else np.minimum).reduce(rows), sum(weights)
        return sum(r * w for r, w in zip(rows, weights)) / sum(weights), sum(weights)

    def heights(self, own: int, row: np.ndarray) -> np.ndarray:
        """Linkage heights from the folded row of cluster ``own``; itself is infinitely far."""
        out = row
        if self.method == "ward":
            a, n = self.active, self.size
            between = row - self.spread[own] - self.spread[a]
            out = np.sqrt(np.maximum(2.0 * n[own] * n[a] / (n[own] + n[a]) * between, 0.0))
        out = out.copy()
        out[np.searchsorted(self.active, own)] = np.inf
        return out

    def merge(self, a: int, b: int, apart: float) -> None:
        """Cluster b joins a, which is the smaller; ``apart`` is their entry of the folded matrix."""
        na, nb = self.size[a], self.size[b]
        n = na + nb
        self.spread[a] = (na * na * self.spread[a] + nb * nb * self.spread[b] + na * nb * apart) / (n * n)
        self.size[a] = n
        self.owner[self.owner == b] = a

    def drop_merged(self) -> None:
        self.active = np.unique(self.owner)


def _rows_of(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        values = batch.column("v")
        width = values.offsets.to_numpy() if batch.num_rows else None
        flat = values.values.to_numpy() if batch.num_rows else None
        for k, r in enumerate(batch.column("r").to_pylist()):
            yield r, flat[width[k]: width[k + 1]]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0)])))


def _folded(state: Clusters, wanted: np.ndarray):
    """One row per wanted cluster and task, over the active clusters, with the members it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, float]] = {}
        ask = np.zeros(len(state.owner), bool)
        ask[wanted] = True
        single = np.bincount(state.owner, minlength=len(state.owner)) == 1
        for r, row in _rows_of(batches):
            own = int(state.owner[r])
            if not ask[own]:
                continue
            folded, weight = state.fold_columns(row), float(state.column_size[r])
            if single[own]:
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([weight]), _lists([folded])], ["r", "w", "v"])
            else:
                before = held.get(own)
                held[own] = state.fold_rows([before[0], folded], [before[1], weight]) if before else (folded, weight)
        for own, (folded, weight) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([weight]), _lists([folded])], ["r", "w", "v"])

    return run


def _whole(state: Clusters):
    """The parts of a cluster's row that tasks have folded, as one row."""

    def run(parts: pa.Table) -> pa.Table:
        rows = [row for _, row in _rows_of(parts.to_batches())]
        folded, weight = state.fold_rows(rows, parts.column("w").to_pylist())
        return pa.table({"r": parts.column("r").slice(0, 1).combine_chunks(), "w": pa.array([weight]), "v": _lists([folded])})

    return run


def _nearest(state: Clusters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, row in _rows_of(batches):
            heights = state.heights(r, row)
            at = int(heights.argmin())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r]), pa.array([int(state.active[at])]), pa.array([float(heights[at])]), pa.array([float(row[at])])], ["r", "near", "height", "apart"])

    return run


def _current(matrix: DataFrame, state: Clusters, wanted: np.ndarray) -> DataFrame:
    """(r, w, v): rows of the wanted clusters over the active ones. Only rows of clusters that have merged leave their task."""
    grown = np.bincount(state.owner, minlength=len(state.owner)) > 1
    schema = "r long, w double, v array<double>"
    out = matrix.mapInArrow(_folded(state, wanted[~grown[wanted]]), schema)
    if grown[wanted].any():
        parts = matrix.mapInArrow(_folded(state, wanted[grown[wanted]]), schema)
        out = out.unionByName(parts.groupBy("r").applyInArrow(_whole(state), schema))
    return out.select("r", "v")


def _renumbered(place: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place[batch.column("r").to_numpy()]), batch.column("v")], ["r", "v"])

    return run


def _finish(method: str, size: np.ndarray, spread: np.ndarray, node: np.ndarray, number: np.ndarray, step: int):
    """Merge a bounded number of clusters in rounds of reciprocal nearest ones, in the same order as the rounds of jobs."""

    def run(rows: pa.Table) -> pa.Table:
        state, out, at = Clusters(method, size, spread), [], step
        matrix = np.zeros((len(size), len(size)))
        for r, row in _rows_of(rows.to_batches()):
            matrix[r] = row
        names = node.copy()
        while len(state.active) > 1:
            current = matrix[np.ix_(state.active, state.active)]
            heights = np.stack([state.heights(int(own), current[k]) for k, own in enumerate(state.active)])
            near = heights.argmin(axis=1)
            pairs = [(k, int(m)) for k, m in enumerate(near) if k < m and near[m] == k]
            for k, m in pairs:
                a, b = int(state.active[k]), int(state.active[m])
                na, nb = state.size[a], state.size[b]
                out.append((at, number[a], number[b], names[a], names[b], heights[k, m], na + nb, na))
                state.merge(a, b, current[k, m])
                row, _ = state.fold_rows([matrix[a], matrix[b]], [na, nb])
                matrix[a], matrix[:, a] = row, row
                names[a], at = at, at + 1
            state.drop_merged()
        columns = list(zip(*out)) if out else [()] * 8
        kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 2
        return pa.table([pa.array([float(x) if k == pa.float64() else int(x) for x in c], k) for c, k in zip(columns, kinds)], [c.split()[0] for c in MERGES.split(", ")])

    return run


def matrix_rows(cells: DataFrame, n: int) -> DataFrame:
    """(r, v): the complete matrix (r, c, s) over 0 to n - 1 as written rows, laid out in strips of bounded size."""
    each = max(STRIP_CELLS // max(n, 1), 1)

    def lay(part: pa.Table) -> pa.Table:
        own, at = np.unique(part.column("r").to_numpy(), return_inverse=True)
        dense = np.full((len(own), n), np.inf)
        dense[at, part.column("c").to_numpy()] = part.column("s").to_numpy()
        dense[np.arange(len(own)), own] = 0.0
        return pa.table({"r": pa.array(own), "v": _lists(list(dense))})

    return settle(cells.groupBy(F.floor(F.col("r") / each).alias("strip")).applyInArrow(lay, "r long, v array<double>"))


def linkage(matrix: DataFrame, n: int, method: str, last: int = LAST_CLUSTERS) -> DataFrame:
    """Merges (``MERGES``) of a complete matrix, for ward of squared distances.

    Numbers are in the order of ids, so that the smaller number is the smaller id; a cluster's number is its smallest.
    ``left_step`` is the merge that made the left cluster, or -1 - number for a leaf. Equal heights go to the smaller number. The
    last clusters, a bounded number, are merged in one task in the same order, which saves a job per round.
    """
    spark = matrix.sparkSession
    path = scratch_path(spark, "merges")
    state, written = Clusters(method, np.ones(n), np.zeros(n)), matrix
    number, node = np.arange(n), -1 - np.arange(n)
    near, height, apart = np.full(n, -1), np.full(n, np.inf), np.zeros(n)
    step, stale = 0, state.active
    while len(state.active) > max(last, 1):
        found = _current(written, state, stale).mapInArrow(_nearest(state), "r long, near long, height double, apart double")
        for r in found.toLocalIterator():
            near[r["r"]], height[r["r"]], apart[r["r"]] = r["near"], r["height"], r["apart"]
        active = state.active
        pairs = active[(near[near[active]] == active) & (active < near[active])]
        if not len(pairs):
            # rows folded in another order can differ in the last digit and chase each other round; the nearest pair goes first
            first = min(active.tolist(), key=lambda k: (height[k], min(k, near[k]), max(k, near[k])))
            other = int(near[first])
            pairs = np.array([min(first, other)])
            near[pairs[0]], height[pairs[0]], apart[pairs[0]] = max(first, other), height[first], apart[first]
        made = []
        for a in pairs.tolist():
            b = int(near[a])
            made.append((step, int(number[a]), int(number[b]), int(node[a]), int(node[b]), float(height[a]), int(state.size[a] + state.size[b]), int(state.size[a])))
            state.merge(a, b, float(apart[a]))
            node[a], step = step, step + 1
        spark.createDataFrame(made, MERGES).write.mode("append").parquet(path)
        state.drop_merged()
        # by these linkages nothing comes nearer when two others merge, so only who has merged or lost its nearest asks again
        merged = np.union1d(pairs, near[pairs])
        stale = state.active[np.isin(state.active, merged) | np.isin(near[state.active], merged)]
        if 2 * len(state.active) <= len(state.owner):
            kept = state.active
            place = np.zeros(len(state.owner), np.int64)
            place[kept] = np.arange(len(kept))
            smaller = settle(_current(written, state, kept).mapInArrow(_renumbered(place), "r long, v array<double>"))
            if written is not matrix:
                forget(written)
            written, number, node = smaller, number[kept], node[kept]
            near, height, apart, stale = place[near[kept]], height[kept], apart[kept], place[stale]
            state = Clusters(method, state.size[kept], state.spread[kept])
    kept = state.active
    place = np.zeros(len(state.owner), np.int64)
    place[kept] = np.arange(len(kept))
    rows = _current(written, state, kept).mapInArrow(_renumbered(place), "r long, v array<double>")
    done = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_finish(method, state.size[kept], state.spread[kept], node[kept], number[kept], step), MERGES)
    done.write.mode("append").parquet(path)
    if written is not matrix:
        forget(written)
    return spark.read.schema(MERGES).parquet(path)


class PointClusters:
    """Ward's clusters of points: sums of coordinates, sizes, numbers (smallest members, ascending) and nodes of the dendrogram.

    Heights are worked out from whole sums, not from means, so they are the same from both sides and, for coordinates on
    a grid, equal ones stay equal.
    """

    def __init__(self, total: np.ndarray, size: np.ndarray, number: np.ndarray, node: np.ndarray, step: int = 0):
        self.total, self.size, self.number, self.node, self.step = total, size, number, node, step
        self.near, self.height = np.zeros(len(size), np.int64), np.zeros(len(size))
        self.stale = np.arange(len(size))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and height of the nearest cluster of each of these; of equal ones that of the smallest number."""
        m, near, height = len(self.size), [np.zeros(0, np.int64)], [np.zeros(0)]
        each = max(STRIP_CELLS // m, 1)
        for at in range(0, len(rows), each):
            own = rows[at: at + each]
            n, squares = self.size[own, None].astype(float), np.zeros((len(own), m))
            for k in range(self.total.shape[1]):
                squares += (self.total[own, k, None] * self.size - self.total[:, k] * n) ** 2
            squares *= 2.0 / (n * self.size * (n + self.size))
            squares[np.arange(len(own)), own] = np.inf
            near.append(squares.argmin(axis=1))
            height.append(np.sqrt(squares[np.arange(len(own)), near[-1]]))
        return np.concatenate(near), np.concatenate(height)

    def found(self, rows: np.ndarray, near: np.ndarray, height: np.ndarray) -> None:
        self.near[rows], self.height[rows] = near, height

    def merge(self, a: np.ndarray, b: np.ndarray, height: np.ndarray) -> list[tuple]:
        """Cluster b joins a, pair by pair, none of them twice."""
        steps, size = self.step + np.arange(len(a)), self.size
        made = [steps, self.number[a], self.number[b], self.node[a], self.node[b], height, size[a] + size[b], size[a]]
        made = list(zip(*[c.tolist() for c in made]))
        self.total[a] += self.total[b]
        self.size[a] += self.size[b]
        self.node[a], self.step = steps, self.step + len(a)
        # by ward nothing comes nearer when two others merge, so only who has merged or lost its nearest asks again
        touched = np.zeros(len(self.size), bool)
        touched[a], touched[b] = True, True
        kept = np.ones(len(self.size), bool)
        kept[b] = False
        asks = (touched | touched[self.near])[kept]
        place = np.cumsum(kept) - 1
        for name in ("total", "size", "number", "node", "height"):
            setattr(self, name, getattr(self, name)[kept])
        self.near, self.stale = place[self.near[kept]], np.flatnonzero(asks)
        return made

    def merge_nearest(self) -> list[tuple]:
        """All reciprocal nearest clusters; where rounding leaves none, the nearest pair."""
        own = np.arange(len(self.size))
        a = own[(self.near[self.near] == own) & (own < self.near)]
        if not len(a):
            low, high = np.minimum(own, self.near), np.maximum(own, self.near)
            first = np.lexsort((high, low, self.height))[:1]
            return self.merge(low[first], high[first], self.height[first])
        return self.merge(a, self.near[a], self.height[a])

    def merge_equal(self, marks: np.ndarray) -> list[tuple]:
        """Rows whose marks are equal, from the smallest number on: what rounds would merge one by one at height 0."""
        _, group = np.unique(marks, axis=0, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        first = np.flatnonzero(np.diff(group.ravel()[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
        made, alive = [], np.repeat(order[first], np.diff([*first, len(order)]))
        for k in range(1, int(rank.max(initial=0)) + 1):
            here = rank == k
            a, b = np.searchsorted(self.number, alive[here]), np.searchsorted(self.number, order[here])
            at = np.argsort(a)
            made += self.merge(a[at], b[at], np.zeros(len(a)))
        self.stale = np.arange(len(self.size))
        return made


def _asked(state: PointClusters, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rows = np.array_split(state.stale, tasks)[k]
                near, height = state.nearest(rows)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(near), pa.array(height)], ["r", "near", "height"])

    return run


def _rest(state: PointClusters):
    """The last clusters, a bounded number, merged in the same rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for _ in batches:
            while len(state.size) > 1:
                state.found(state.stale, *state.nearest(state.stale))
                made += state.merge_nearest()
        columns = list(zip(*made)) if made else [()] * 8
        kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in MERGES.split(", ")])

    return run


def ward_merges(spark: SparkSession, points: np.ndarray, last: int = LAST_CLUSTERS) -> DataFrame:
    """Merges (``MERGES``) of ward's linkage of n points, in the order of their numbers, without a table of pairs.

    The state, a few numbers per cluster, goes to all tasks in each round; a task works out the heights between its share of the
    clusters that have lost their nearest and all others, strip by strip. Nothing but a row per such cluster comes back.
    """
    n = len(points)
    state = PointClusters(points.astype(float), np.ones(n, np.int64), np.arange(n), -1 - np.arange(n))
    made = state.merge_equal(state.total)
    while len(state.size) > max(last, 1):
        tasks = -(-len(state.stale) * len(state.size) // TASK_CELLS)
        asked = spark.range(0, tasks, 1, tasks).mapInArrow(_asked(state, tasks), "r long, near long, height double").toArrow()
        state.found(*[asked.column(c).to_numpy() for c in ("r", "near", "height")])
        made += state.merge_nearest()
    rest = spark.range(0, 1, 1, 1).mapInArrow(_rest(state), MERGES)
    return settle(spark.createDataFrame(made, MERGES).unionByName(rest))


def _products(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Products of the sparse vectors of two blocks, by strips of the keys that occur."""
    keys, values = (pa.concat_arrays([*left.column(c).chunks, *right.column(c).chunks]) for c in ("keys", "values"))
    column = pc.dictionary_encode(keys.flatten()).indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(keys)), pc.list_value_length(keys).to_numpy(zero_copy_only=False))
    order = np.argsort(column, kind="stable")
    column, row, value = column[order], row[order], values.flatten().to_numpy(zero_copy_only=False)[order]
    out, width = np.zeros((left.num_rows, right.num_rows)), int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, KEYS_PER_STRIP):
        at = slice(*np.searchsorted(column, [low, low + KEYS_PER_STRIP]))
        dense = np.zeros((len(keys), min(KEYS_PER_STRIP, width - low)))
        dense[row[at], column[at] - low] = value[at]
        out += dense[:len(out)] @ dense[len(out):].T
    return out


def _mean_distances(state: PointClusters, left: pa.Table, right: pa.Table) -> np.ndarray:
    """Mean of 1 - r between clusters; no mean of correlations is above 1. A cluster is infinitely far from itself."""
    a, b = (np.searchsorted(state.number, t.column("number").to_numpy()) for t in (left, right))
    shared = _products(left, right) - state.total[a] * state.total[b, 0]
    out = np.maximum(1.0 - shared / (state.size[a, None].astype(float) * state.size[b]), 0.0)
    out[a[:, None] == b] = np.inf
    return out


def _nearest_vector(state: PointClusters):
    def run(tile: pa.Table) -> pa.Table:
        left, right = (tile.filter(pc.equal(tile.column("side"), side)) for side in (0, 1))
        if not left.num_rows or not right.num_rows:
            left = left.slice(0, 0)
            return pa.table({"number": left.column("number"), "near": left.column("number"), "height": pa.array([], pa.float64())})
        right = right.sort_by("number")  # of equal heights the first is the smallest number
        apart = _mean_distances(state, left, right)
        near = apart.argmin(axis=1)
        return pa.table({"number": left.column("number"), "near": right.column("number").take(pa.array(near)), "height": pa.array(apart[np.arange(len(near)), near])})

    return run


def _sum_vectors(rows: pa.Table) -> pa.Table:
    """The vectors of the members of one cluster as one."""
    keys, values = (pa.concat_arrays(rows.column(c).chunks).flatten() for c in ("keys", "values"))
    coded = pc.dictionary_encode(keys)
    total = np.bincount(coded.indices.to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False), len(coded.dictionary))
    ends = pa.array([0, len(total)], pa.int32())
    return pa.table({
        "number": rows.column("number").slice(0, 1), "keys": pa.ListArray.from_arrays(ends, coded.dictionary), "values": pa.ListArray.from_arrays(ends, pa.array(total))})


def _moved(vectors: DataFrame, made: list[tuple]) -> DataFrame:
    """The table of vectors after merges; only those of clusters that have merged are shuffled."""
    spark = vectors.sparkSession
    moves = [(b, a) for _, a, b, *_ in made]
    table = spark.createDataFrame(moves + [(a, a) for a in {a for _, a in moves}], "number long, _to long")
    rows = vectors.join(F.broadcast(table), "number", "left")
    grown = rows.filter("_to IS NOT NULL").select(F.col("_to").alias("number"), "keys", "values")
    kept = rows.filter("_to IS NULL").select("number", "keys", "values")
    return settle(kept.unionByName(grown.groupBy("number").applyInArrow(_sum_vectors, vectors.schema)), replaces=vectors)


def _vector_finish(state: PointClusters):
    """The last clusters, a bounded number, as a matrix in one task."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")
        apart = _mean_distances(state, rows, rows)
        np.fill_diagonal(apart, 0.0)
        finish = _finish("average", state.size, np.zeros(len(state.size)), state.node, state.number, state.step)
        return finish(pa.table({"r": pa.array(np.arange(len(apart))), "v": _lists(list(apart))}))

    return run


def vector_merges(vectors: DataFrame, shift: np.ndarray, marks: np.ndarray, cells: int, last: int = LAST_CLUSTERS) -> DataFrame:
    """Merges (``MERGES``) of average linkage of distances 1 - r without a table of pairs.

    ``vectors`` (number, keys, values) and ``shift`` give r = v_i·v_j - s_i s_j; rows of equal ``marks`` have equal vectors. Clusters
    are sums of their members' vectors. In a round the clusters that have lost their nearest meet all others, tile by tile, and a
    row per such cluster and tile comes back; then the vectors of merged clusters are added.
    """
    spark, n = vectors.sparkSession, len(shift)
    state = PointClusters(shift[:, None].astype(float), np.ones(n, np.int64), np.arange(n), -1 - np.arange(n))
    vectors, made = settle(vectors.select("number", "keys", "values")), state.merge_equal(marks)
    if made:
        vectors = _moved(vectors, made)
    while len(state.size) > max(last, 1):
        m = len(state.size)
        each = min(block_files(m), max(BLOCK_CELLS // max(cells // m, 1), 1))
        asks, blocks = -(-len(state.stale) // each), -(-m // each)
        table = spark.createDataFrame([(k,) for k in state.number[state.stale].tolist()], "number long")
        asking = vectors if len(state.stale) == m else vectors.join(F.broadcast(table), "number", "left_semi")
        own = lambda count: F.pmod(F.xxhash64("number"), F.lit(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        sent = asking.select("*", F.lit(0).alias("side"), own(asks).alias("bi"), every(blocks).alias("bj")).unionByName(
            vectors.select("*", F.lit(1).alias("side"), every(asks).alias("bi"), own(blocks).alias("bj")))
        found = sent.groupBy("bi", "bj").applyInArrow(_nearest_vector(state), "number long, near long, height double")
        best = found.groupBy("number").agg(F.min(F.struct("height", "near")).alias("e")).select("number", "e.near", "e.height").toArrow()
        rows, near = (np.searchsorted(state.number, best.column(c).to_numpy()) for c in ("number", "near"))
        state.found(rows, near, best.column("height").to_numpy())
        merged = state.merge_nearest()
        made += merged
        vectors = _moved(vectors, merged)
    rest = vectors.groupBy(F.lit(0).alias("all")).applyInArrow(_vector_finish(state), MERGES)
    out = settle(spark.createDataFrame(made, MERGES).unionByName(rest))
    forget(vectors)
    return out


def _cheapest(label: np.ndarray):
    """The shortest edge out of each component that a task sees, by (length, smaller end, greater end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[float, int, int]] = {}
        for r, row in _rows_of(batches):
            out = np.where(label == label[r], np.inf, row)
            short = out.min()
            for c in np.flatnonzero(out == short)[[0, -1]].tolist() if np.isfinite(short) else []:
                edge = (float(short), min(r, c), max(r, c))
                held[int(label[r])] = min(held.get(int(label[r]), edge), edge)
        if held:
            names, edges = list(held), [list(x) for x in zip(*held.values())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(edges[0], pa.float64()), pa.array(edges[1], pa.int64()), pa.array(edges[2], pa.int64())], ["label", "d", "a", "b"])

    return run


def spanning_tree(matrix: DataFrame, n: int) -> np.ndarray:
    """(n - 1, 3) rows (length, smaller end, greater end) of the minimum spanning tree, sorted.

    Every round reads the matrix once, takes the shortest edge out of each component and hooks components along them, so at most
    half are left: the number of rounds is the logarithm of n, and nothing but edges is written.
    """
    label, edges = np.arange(n), set()
    while len(edges) < n - 1:
        seen = matrix.mapInArrow(_cheapest(label), "label long, d double, a long, b long")
        best = seen.groupBy("label").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.*")
        found = {(r["d"], r["a"], r["b"]) for r in best.toLocalIterator()}
        if not found:
            raise ValueError("the matrix lacks pairs that would connect all numbers")
        edges |= found
        # hook: the smallest label of the two ends, followed to the end of the path
        parent = np.arange(n)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for _, a, b in found:
            p, q = root(int(label[a])), root(int(label[b]))
            parent[max(p, q)] = min(p, q)
        label = np.array([root(int(x)) for x in label])
    return np.array(sorted(edges), float).reshape(-1, 3)


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of the minimum spanning forest, of edges (d, a, b) with a < b in that order, shortest first."""
    order = np.lexsort((b, a, d))
    a, b, label, alive, kept = a[order], b[order], np.arange(n), np.arange(len(order)), []
    while len(alive):
        x, y = label[a[alive]], label[b[alive]]
        out = x != y
        alive, x, y = alive[out], x[out], y[out]
        if not len(alive):
            break
        # edges are in order, so of the edges out of a component the one written last, from the back, is the shortest
        best, towards = np.full(n, -1), np.arange(n)
        for ends, others in ((x, y), (y, x)):
            first = np.full(n, -1)
            first[ends[::-1]] = np.arange(len(alive))[::-1]
            better = (first >= 0) & ((best < 0) | (first < best))
            best[better], towards[better] = first[better], others[first[better]]
        kept.append(np.unique(alive[best[best >= 0]]))
        # two components that chose the same edge point at each other; the smaller one is the root
        both = (towards[towards] == np.arange(n)) & (np.arange(n) < towards)
        towards[both] = np.flatnonzero(both)
        while not np.array_equal(towards, towards[towards]):
            towards = towards[towards]
        label = towards[label]
    return order[np.sort(np.concatenate([*kept, np.zeros(0, np.int64)]))]


def _forests(n: int, most: int):
    """The edges that a task's pairs leave in their spanning forest; what is held never exceeds ``most`` pairs and the forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b", "d")])
            waiting += batch.num_rows
            if waiting >= most:
                held, waiting = [_fold(held, n)], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _fold(held, n)], ["a", "b", "d"])

    return run


def _fold(held: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
    a, b, d = (np.concatenate(x) for x in zip(*held))
    kept = forest(a, b, d, n)
    return [a[kept], b[kept], d[kept]]


def pair_tree(pairs: DataFrame, n: int, most: int = FOREST_PAIRS) -> np.ndarray:
    """(n - 1, 3) rows (length, smaller end, greater end) of the minimum spanning tree of all pairs (a, b, d), sorted.

    An edge that is not in the forest of some of the pairs is not in that of all. So every task keeps the forest of its pairs
    while they pass, fewer than n edges; those are folded once more by few tasks, and what these leave on the driver. The
    pairs are read once and neither moved nor written.
    """
    edges, schema = pairs.select("a", "b", "d"), "a long, b long, d double"
    few = edges.mapInArrow(_forests(n, most), schema).repartition(FOREST_TASKS).mapInArrow(_forests(n, most), schema).toArrow()
    a, b, d = (few.column(c).to_numpy() for c in ("a", "b", "d"))
    kept = forest(a, b, d, n)
    if len(kept) < n - 1:
        raise ValueError("the table lacks pairs that would connect all numbers")
    return np.stack([d[kept], a[kept], b[kept]], axis=1).astype(float).reshape(-1, 3)


def tile_tree_edges(apart: np.ndarray, left: np.ndarray, right: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (smaller number, greater number, length) of the minimum spanning tree of one tile, by Prim's method.

    ``apart`` has the distances between the numbers ``left`` and ``right``, which are disjoint; without ``right`` it is square, over
    ``left`` alone, and its diagonal is not read. Edges are in the strict order (length, smaller number, greater number).
    """
    own, size = right is None, len(left)
    number = left.astype(np.int64) if own else np.concatenate([left, right]).astype(np.int64)
    best, code, towards = np.full(len(number), np.inf), np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    waits, at, edges = np.ones(len(number), bool), 0, []
    waits[0] = False
    for _ in range(len(number) - 1):
        if own:
            reach, new = slice(None), apart[at]
        elif at < size:
            reach, new = slice(size, None), apart[at]
        else:
            reach, new = slice(0, size), apart[:, at - size]
        old, closer = best[reach], waits[reach] & (new <= best[reach])
        found = np.flatnonzero(closer)
        if len(found):
            mine = number[reach][found]
            names = np.minimum(mine, number[at]) * n + np.maximum(mine, number[at])
            taken = (new[found] < old[found]) | (names < code[reach][found])
            found = found[taken] + (reach.start or 0)
            best[found], code[found], towards[found] = new[found - (reach.start or 0)], names[taken], number[at]
        at = int(best.argmin())
        equal = np.flatnonzero(best == best[at])
        if len(equal) > 1:
            equal = equal[waits[equal]]
            at = int(equal[code[equal].argmin()])
        edges.append((number[at], towards[at], best[at]))
        waits[at], best[at] = False, np.inf
    a, b, d = (np.array(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64), d.astype(float)


def tile_tree(rows: DataFrame, n: int, each: int, measure, most: int = FOREST_PAIRS) -> np.ndarray:
    """(n - 1, 3) rows (length, smaller end, greater end) of the minimum spanning tree of n numbers, sorted, without a row per pair.

    ``measure`` makes the matrix of finite distances between two tables of ``rows``, which have a column ``number``. Numbers form
    blocks of ``each``; a pair of blocks is a tile, whose spanning tree, one edge per number, is all that leaves its task.
    """
    blocks = -(-n // each)

    def fold(table: pa.Table) -> pa.Table:
        block, bi, bj = (table.column(c).to_numpy() for c in ("block", "bi", "bj"))
        left, right = (table.filter(pa.array(block == side)) for side in (bi, bj))
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], kind) for c, kind in (("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64()))})
        ends = [t.column("number").to_numpy() for t in (left, right)]
        apart = measure(left, right)
        return pa.table(dict(zip("abd", map(pa.array, tile_tree_edges(apart, ends[0], None if bi[0] == bj[0] else ends[1], n)))))

    sent = block_pairs(rows.withColumn("block", F.pmod("number", F.lit(blocks)).cast("int")), blocks)
    return pair_tree(sent.groupBy("bi", "bj").applyInArrow(fold, "a long, b long, d double"), n, most)


def point_distances(left: pa.Table, right: pa.Table, dims: list[str]) -> np.ndarray:
    """Euclidean distances between the points of two tables, as ``soma_distances`` has them."""
    total = np.zeros((left.num_rows, right.num_rows))
    for d in dims:
        total += (left.column(d).to_numpy()[:, None] - right.column(d).to_numpy()[None, :]) ** 2
    return np.sqrt(total, out=total)


def count_distances(left: pa.Table, right: pa.Table, v: float) -> np.ndarray:
    """1 - r between vectors of counts (keys, values, sx, var) of two tables over v voxels, as ``pearson`` has them."""
    out = _products(left, right)
    (sx, var), (sx_j, var_j) = ([t.column(c).to_numpy() for c in ("sx", "var")] for t in (left, right))
    step = max(STRIP_PAIRS // max(right.num_rows, 1), 1)
    for at in range(0, len(out), step):
        part = slice(at, at + step)
        out[part] = 1.0 - (v * out[part] - sx[part, None] * sx_j) / np.sqrt(var[part, None] * var_j)
    return out


def single_merges(spark: SparkSession, tree: np.ndarray, n: int) -> DataFrame:
    """Merges (``MERGES``) of single linkage: the edges of the spanning tree from the shortest on."""
    parent, size, node = np.arange(n), np.ones(n, np.int64), -1 - np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    made = []
    for step, (d, x, y) in enumerate(tree.tolist()):
        p, q = root(int(x)), root(int(y))
        a, b = min(p, q), max(p, q)
        made.append((step, int(a), int(b), int(node[a]), int(node[b]), d, int(size[a] + size[b]), int(size[a])))
        parent[b], size[a], node[a] = a, size[a] + size[b], step
    return spark.createDataFrame(made, MERGES)
