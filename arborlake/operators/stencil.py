"""Neighbourhoods of voxels in blocks: a block receives the rims of its neighbours once and is worked on as an array."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..model import Grid, pack_voxel
from .blocks import SIDE

#: Lines of a tile in which distances are carried along one axis: 32 by 32 of them.
TILE = 32


def with_rims(rows: DataFrame, names: Sequence[str], reach: int, last: Sequence[int] | None = None) -> DataFrame:
    """Rows once per block that they lie in or within ``reach`` cells of, with ``_block`` and ``_own`` for the block they lie in.

    ``last`` are the highest cells of the axes, where there is an end.
    """
    out, own = rows, F.lit(True)
    for k, name in enumerate(names):
        low, high = F.col(name) - reach, F.col(name) + reach
        if last is not None:
            low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(int(last[k])))
        out = out.withColumn(f"_b{k}", F.explode(F.sequence(F.floor(low / SIDE), F.floor(high / SIDE))))
        own = own & (F.col(f"_b{k}") == F.floor(F.col(name) / SIDE))
    blocks = [f"_b{k}" for k in range(len(names))]
    return out.withColumns({"_block": pack_voxel(*[F.col(b) for b in blocks]), "_own": own}).drop(*blocks)


def beside(cells: DataFrame, names: Sequence[str], directions: Sequence[tuple[int, int, int]], group: str | None = None, present: bool = False) -> DataFrame:
    """(group, cell, way): cells whose neighbour in a direction is missing, or present; ``way`` is the direction's number.

    Neighbours are cells of the same group. One exchange, in which only rims are sent twice.
    """
    keys = [*([group] if group else []), *names]
    rows = with_rims(cells.select(*keys), names, 1)

    def run(block: pa.Table) -> pa.Table:
        place = np.stack([block.column(n).to_numpy().astype(np.int64) for n in names])
        place = place - place.min(axis=1, keepdims=True) + 1
        size = place.max(axis=1) + 2
        codes = np.zeros(block.num_rows, np.int64)
        if group:
            codes = block.column(group).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        for axis, n in zip(place, size):
            codes = codes * n + axis
        there = np.unique(codes)
        own = np.flatnonzero(block.column("_own").to_numpy(zero_copy_only=False))
        picked, ways = [], []
        for way, (a, b, c) in enumerate(directions):
            beyond = codes[own] + (a * size[1] + b) * size[2] + c
            hit = own[np.isin(beyond, there) == present]
            picked.append(hit)
            ways.append(np.full(len(hit), way, np.int32))
        return block.select(keys).take(pa.array(np.concatenate(picked))).append_column("way", pa.array(np.concatenate(ways)))

    schema = T.StructType([*[cells.schema[k] for k in keys], T.StructField("way", T.IntegerType())])
    return rows.groupBy("_block").applyInArrow(run, schema)


def convolve(volume: DataFrame, grid: Grid, names: Sequence[str], value: str, weights: Sequence[float]) -> DataFrame:
    """The volume under a separable kernel of odd length, edge values going on beyond the grid; cells that nothing reaches stay absent."""
    reach = len(weights) // 2
    rows = with_rims(volume.select(*[F.col(n).cast("long").alias(n) for n in names], F.col(value).cast("double").alias(value)), names, reach, [n - 1 for n in grid.shape])
    rows = rows.withColumns({f"_at{k}": F.floor(F.col(n) / SIDE) for k, n in enumerate(names)})
    shape = np.array(grid.shape)

    def along(cells: np.ndarray, axis: int) -> np.ndarray:
        cells = np.moveaxis(cells, axis, 0)
        size = len(cells) - 2 * reach
        out = weights[0] * cells[:size]
        for k in range(1, len(weights)):
            out = out + weights[k] * cells[k: k + size]
        return np.moveaxis(out, 0, axis)

    def run(key: tuple, block: pa.Table) -> pa.Table:
        packed = key[0].as_py()
        low = np.array([(packed >> s & (1 << 21) - 1) - (1 << 20) for s in (42, 21, 0)]) * SIDE
        high = np.minimum(low + SIDE, shape)
        first, until = np.maximum(low - reach, 0), np.minimum(high + reach, shape)
        cells, reached = np.zeros(until - first), np.zeros(until - first)
        at = tuple(block.column(n).to_numpy() - first[k] for k, n in enumerate(names))
        np.add.at(cells, at, block.column(value).to_numpy())
        reached[at] = 1.0
        # what lies beyond the grid has the value of its edge
        edges = [(int(f - (lo - reach)), int(hi + reach - u)) for f, u, lo, hi in zip(first, until, low, high)]
        cells, reached = np.pad(cells, edges, mode="edge"), np.pad(reached, edges, mode="edge")
        for axis in range(3):
            cells, reached = along(cells, axis), along(reached, axis)
        found = np.nonzero(reached)
        columns = [pa.array((f + low[k]).astype(np.int64)) for k, f in enumerate(found)]
        return pa.Table.from_arrays([*columns, pa.array(cells[found])], [*names, value])

    schema = ", ".join(f"{n} long" for n in names) + f", {value} double"
    return rows.groupBy("_block").applyInArrow(run, schema)


def _envelope(line: np.ndarray, place: np.ndarray, floor: np.ndarray, spacing: float, size: int, most: float):
    """For every cell of every line the row whose parabola floor + (spacing * (cell - place))^2 is lowest, where that is at most ``most``.

    Rows come sorted by line and place. Each line keeps a stack of the parabolas of its lower envelope; all lines take their
    next row at once. Returns (row, cell).
    """
    _, begin, count = np.unique(line, return_index=True, return_counts=True)
    lines, step = len(begin), spacing * spacing
    rise = floor + step * place * place.astype(float)
    stack = np.zeros((lines, count.max()), np.int64)
    since = np.full((lines, count.max()), -np.inf)
    top = np.full(lines, -1)
    for s in range(count.max()):
        on = np.flatnonzero(count > s)
        row = begin[on] + s
        cross = np.full(len(on), -np.inf)
        open_ = np.flatnonzero(top[on] >= 0)
        while len(open_):
            here = on[open_]
            below = stack[here, top[here]]
            cross[open_] = (rise[row[open_]] - rise[below]) / (2 * step * (place[row[open_]] - place[below]))
            hidden = cross[open_] <= since[here, top[here]]
            top[here[hidden]] -= 1
            gone = open_[hidden]
            cross[gone[top[on[gone]] < 0]] = -np.inf
            open_ = gone[top[on[gone]] >= 0]
        top[on] += 1
        stack[on, top[on]], since[on, top[on]] = row, cross
    # the parabola of a cell is the last one that begins at or before it
    width = size + 4.0
    used = np.arange(since.shape[1])[None, :] <= top[:, None]
    starts = (np.clip(since, -1, size + 1) + 1 + np.arange(lines)[:, None] * width)[used]
    cells = np.tile(np.arange(size), lines)
    owner = np.repeat(np.arange(lines), size)
    row = stack[used][np.searchsorted(starts, cells + 1 + owner * width, "right") - 1]
    away = spacing * (cells - place[row])
    near = floor[row] + away * away <= most
    return row[near], cells[near]


def offsets_to_nearest(cells: DataFrame, grid: Grid, radius: float, names: Sequence[str]) -> DataFrame:
    """(cell, da, db, dc): every cell of the grid within ``radius`` of one of ``cells``, with the steps from the nearest one.

    The exact Euclidean distance is separable: the squared distance along one axis is the floor of parabolas along the next. So
    there is one grouped pass per axis over tiles of lines, and rows grow with the surface times the radius.
    """
    rows = cells.select(*[F.col(n).cast("long").alias(n) for n in names], *[F.lit(0).cast("long").alias(d) for d in ("da", "db", "dc")])
    schema = ", ".join(f"{n} long" for n in [*names, "da", "db", "dc"])
    most = radius * radius * (1 + 1e-12)
    spacing = grid.resolution

    def along(axis: int):
        others = [k for k in range(3) if k != axis]

        def run(tile: pa.Table) -> pa.Table:
            place = [tile.column(n).to_numpy() for n in names]
            steps = [tile.column(d).to_numpy() for d in ("da", "db", "dc")]
            line = place[others[0]] * grid.shape[others[1]] + place[others[1]]
            order = np.lexsort((place[axis], line))
            floor = sum((steps[k] * spacing[k]) ** 2.0 for k in range(3))
            row, cell = _envelope(line[order], place[axis][order], floor[order], spacing[axis], grid.shape[axis], most)
            row = order[row]
            out = [place[k][row] if k != axis else cell.astype(np.int64) for k in range(3)]
            moved = [steps[k][row] if k != axis else cell - place[axis][row] for k in range(3)]
            return pa.Table.from_arrays([pa.array(c) for c in (*out, *moved)], [*names, "da", "db", "dc"])

        return others, run

    for axis in (2, 1, 0):
        others, run = along(axis)
        rows = rows.groupBy(*[F.floor(F.col(names[k]) / TILE).alias(f"_t{k}") for k in others]).applyInArrow(run, schema)
    return rows
