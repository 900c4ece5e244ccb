"""Edges of groups of nodes cut and folded as arrays: the arithmetic of ``profile.split_edges`` without a row per portion.

Edges become a table of crossings, one line per edge and sorted along it; what leaves is one row per place, side and compartment.
Null and not finite coordinates give what the column expressions of ``profile`` give: NaN counts as the largest number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..model import SOMA, Grid

#: Crossings that are laid out at once, and sums that are held in a plain array.
CELLS = 1 << 20
PLAIN_SUMS = 1 << 20
#: Voxels up to which regions are held by place in the grid.
DENSE_VOXELS = 1 << 24
SIDES = np.array(["lower", "upper", "midline"])
COMPARTMENTS = np.array(["neurite", "soma"])


@dataclass(frozen=True)
class Volume:
    """Regions of voxels as places in ``names``, by place in the grid or by search in sorted voxels; the first name is 0, no region."""

    voxels: np.ndarray | None
    codes: np.ndarray
    names: np.ndarray

    @classmethod
    def of(cls, grid: Grid, voxels: np.ndarray, regions: np.ndarray) -> Volume:
        found, codes = np.unique(regions, return_inverse=True)
        names, codes, size = np.concatenate([[0], found]), codes.astype(np.int32) + 1, int(np.prod(grid.shape, dtype=object))
        if size <= DENSE_VOXELS:
            dense = np.zeros(size + 1, np.int32)  # the last one is outside the grid
            dense[voxels] = codes
            return cls(None, dense, names)
        order = np.argsort(voxels)
        return cls(voxels[order], codes[order], names)

    def at(self, voxel: np.ndarray) -> np.ndarray:
        """Places of the regions of voxels; -1 is a voxel outside the grid."""
        if self.voxels is None:
            return self.codes[voxel]
        if not len(self.voxels):
            return np.zeros(len(voxel), np.int32)
        place = np.minimum(np.searchsorted(self.voxels, voxel), len(self.voxels) - 1)
        return np.where(self.voxels[place] == voxel, self.codes[place], 0)


def _above(a, b) -> np.ndarray:
    """a > b where NaN is the largest number."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _index(values: np.ndarray, step: float, nan: bool) -> np.ndarray:
    """The whole number below, as a float; that of NaN is 0."""
    out = np.floor(values / step)
    return np.where(np.isnan(out), 0.0, out) if nan else out


def crossings(one: np.ndarray, two: np.ndarray, grid: Grid, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cuts of every edge from ``one`` to ``two``, (3, n) each, filled up with inf, and how many there are."""
    n, mid, nan = one.shape[1], float(grid.midline_um), bool(np.isnan(one).any() or np.isnan(two).any())
    above = _above if nan else np.greater
    inside, base, found = np.ones(n, bool), np.zeros(n, np.int64), []
    for axis, (size, step) in enumerate(zip(grid.shape, grid.resolution)):
        a, b = one[axis], two[axis]
        low, high, width = np.fmin(a, b), np.maximum(a, b), b - a  # NaN, the largest, is the higher end
        first = np.clip(-_index(-low, step, nan), 0, size + 1)
        last = np.clip(_index(high, step, nan), -1, size)
        count = np.where(width != 0, np.maximum(last - first + 1, 0), 0).astype(np.int64)
        owner = np.repeat(np.arange(n), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        plane = (first[owner] + within) * step
        t = (plane - a[owner]) / width[owner]
        t[~(above(plane, low[owner]) & above(high[owner], plane) & (t > gap) & (t < 1 - gap))] = np.inf
        found.append((owner, base[owner] + within, t))
        base += count
        inside &= _index(a, step, nan) == _index(b, step, nan)
    a, b = one[grid.lr_axis], two[grid.lr_axis]
    meets = above(np.full(n, mid), np.fmin(a, b)) & above(np.maximum(a, b), mid)
    t = (mid - a) / (b - a)
    table = np.full((n, int(base.max(initial=0)) + 1), np.inf)
    for owner, column, values in found:
        table[owner, column] = values
    table[np.arange(n), base] = np.where(meets & (t > gap) & (t < 1 - gap), t, np.inf)
    table[inside & ~meets] = np.inf
    table.sort(axis=1)
    count = (table < np.inf).sum(axis=1)
    if table.shape[1] > 1:
        close = (table[:, 1:] - table[:, :-1] <= gap) & (table[:, 1:] < np.inf)
        if close.any():
            table[:, 1:][close] = np.inf
            table.sort(axis=1)
            count -= close.sum(axis=1)
    return table, count


def families(child: np.ndarray, number: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (node, child) of groups: places of nodes, and of their children or -1. A node without children has one row.

    A place stands for a node by its own ``number`` or for a ``child`` by its parent's; a number that repeats meets all children,
    one that is not ``known`` meets none.
    """
    own, kid = np.flatnonzero(~child & known), np.flatnonzero(child)
    own = own[np.argsort(number[own], kind="stable")]
    sorted_numbers, wanted = number[own], number[kid]
    first, last = (np.searchsorted(sorted_numbers, wanted, side) for side in ("left", "right"))
    count = last - first
    parent = own[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    has_child = np.zeros(len(own) + 1, np.int64)
    np.add.at(has_child, first, count > 0)
    np.add.at(has_child, last, -(count > 0).astype(np.int64))
    alone = np.concatenate([own[np.cumsum(has_child[:-1]) == 0], np.flatnonzero(~child & ~known)])
    return np.concatenate([parent, alone]), np.concatenate([np.repeat(kid, count), np.full(len(alone), -1)])


def _coded(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values, null among them."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def group_starts(nodes: pa.Table) -> np.ndarray:
    """Places where another file or group begins, the first row among them; rows of a group lie together."""
    changes = np.zeros(max(nodes.num_rows - 1, 0), bool)
    for name in ("file_id", "_group"):
        changes |= np.diff(_coded(nodes.column(name))) != 0
    return np.concatenate([[0], np.flatnonzero(changes) + 1])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows that are sorted by file and group as tables that end where a group ends; one open group is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if len(group_starts(edge)) > 1:
                yield pa.Table.from_batches(held)
                held = []
        last = int(group_starts(pa.Table.from_batches([batch]))[-1])
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


class Group:
    """The nodes of whole groups of files as arrays, each for itself and for its parent's child (``_child``, ``_key``)."""

    def __init__(self, nodes: pa.Table):
        self.nodes = nodes.combine_chunks()
        starts = group_starts(self.nodes)
        self.first, self.owner = starts, np.repeat(np.arange(len(starts)), np.diff([*starts, self.nodes.num_rows]))
        names, code = np.unique(self._numbers("_key"), return_inverse=True)
        known = self.nodes.column("_key").is_valid().to_numpy()
        self.node, self.child = families(self.nodes.column("_child").to_numpy(), self.owner * len(names) + code, known)

    def _numbers(self, name: str) -> np.ndarray:
        values = self.nodes.column(name)
        return (pc.fill_null(values, 0) if values.null_count else values).to_numpy().astype(np.int64, copy=False)

    def rows(self) -> pa.RecordBatch:
        """(file_id, own_type, own_region, x2, y2, z2, type, x1, y1, z1)."""
        mine, theirs = pa.array(self.node), pa.array(self.child, mask=self.child < 0)
        pick = lambda name, at: self.nodes.column(name).take(at).combine_chunks()
        columns = {"file_id": pick("file_id", mine), "own_type": pick("type", mine), "own_region": pick("region_id", mine)}
        columns |= {f"{c}2": pick(c, mine) for c in "xyz"} | {"type": pick("type", theirs)} | {f"{c}1": pick(c, theirs) for c in "xyz"}
        return pa.RecordBatch.from_pydict(columns)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(3, n) coordinates, and whether they are stored."""
        columns = [self.nodes.column(c) for c in "xyz"]
        known = np.stack([c.is_valid().to_numpy() if c.null_count else np.ones(len(c), bool) for c in columns])
        return np.stack([(pc.fill_null(c, 0) if c.null_count else c).to_numpy().astype(float, copy=False) for c in columns]), known

    def types(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a node's type is known, and whether it is a soma."""
        kind = self.nodes.column("type")
        known = kind.is_valid().to_numpy() if kind.null_count else np.ones(len(kind), bool)
        return known, known & (self._numbers("type") == SOMA)


class Folder:
    """Folds whole groups to (file_id, place, _end, side, compartment, cable, termini).

    With a ``volume`` the place is a region; without one it is a voxel for edges, null outside the grid, and a region for ends.
    """

    def __init__(self, grid: Grid, gap: float, volume: Volume | None):
        self.grid, self.gap, self.volume = grid, gap, volume

    def __call__(self, nodes: pa.Table) -> Iterator[pa.RecordBatch]:
        group = Group(nodes)
        files, (at, known), (typed, soma) = group.nodes.column("file_id").take(pa.array(group.first)).combine_chunks(), group.places(), group.types()
        # a child whose type is not known makes an end of its node, once per portion
        ended = (group.child < 0) | ~typed[group.child]
        whole = known.all(axis=0)
        edge = np.flatnonzero((group.child >= 0) & whole[group.node] & whole[group.child])
        times, cables = np.zeros(len(group.node), np.int64), np.zeros(len(group.node))
        each = max(CELLS // (sum(self.grid.shape) + 4), 1)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            for start in range(0, len(edge), each):
                part = edge[start: start + each]
                ends = ended[part]
                cable, count, place, side = self._portions(at[:, group.child[part]], at[:, group.node[part]])
                own = np.repeat(np.arange(len(part)), count)
                if ends.any():
                    times[part] = np.where(ends, count, 0)
                    cables[part] = np.where(ends, np.bincount(own, cable, len(part)), 0.0)
                kept = ~ends[own] & ((cable > 0) | np.isnan(cable))
                if not kept.all():
                    own, cable, place, side = own[kept], cable[kept], place[kept], side[kept]
                yield self._edges(files, group.owner[group.child[part]][own], cable, place, side * 2 + soma[group.child[part]][own])
        last = np.flatnonzero(ended)
        node = group.node[last]
        c, mid = at[self.grid.lr_axis][node], float(self.grid.midline_um)
        there = known[self.grid.lr_axis][node]
        side = np.where(there & (c == mid), 2, np.where(there & (c < mid), 0, 1))
        termini = np.where(typed[node] & ~soma[node], np.maximum(times[last], 1), 0)
        yield self._ends(files, group.owner[node], group.nodes.column("region_id").take(pa.array(node)), side * 2 + soma[node], cables[last], termini)

    def _portions(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the portions of edges, edge by edge: lengths, numbers of portions per edge, places and sides."""
        grid, nan = self.grid, bool(np.isnan(one).any() or np.isnan(two).any())
        step = two - one
        length = np.sqrt(step[0] ** 2.0 + step[1] ** 2.0 + step[2] ** 2.0)
        table, count = crossings(one, two, grid, self.gap)
        edges = len(length)
        from_t = np.concatenate([np.zeros((edges, 1)), table], axis=1)
        to_t = np.concatenate([table, np.zeros((edges, 1))], axis=1)
        to_t[np.arange(edges), count] = 1.0
        count = np.where((length > 0) | np.isnan(length), count + 1, 0)
        there = np.arange(from_t.shape[1]) < count[:, None]
        own, t0, t1 = np.repeat(np.arange(edges), count), from_t[there], to_t[there]
        t, voxel, held = (t0 + t1) / 2.0, 0, True
        for axis, (size, width) in enumerate(zip(grid.shape, grid.resolution)):
            middle = one[axis][own] + t * step[axis][own]
            index = _index(middle, width, nan)
            held = held & (index >= 0) & (index < size)
            voxel = voxel * size + index
            if axis == grid.lr_axis:
                side = np.where(middle < float(grid.midline_um), 0, 1)
        flat = (one[grid.lr_axis] == float(grid.midline_um)) & (two[grid.lr_axis] == float(grid.midline_um))
        if flat.any():
            side[flat[own]] = 2
        voxel = np.where(held, voxel, -1.0).astype(np.int64)
        return (t1 - t0) * length[own], count, voxel if self.volume is None else self.volume.at(voxel), side

    def _edges(self, files: pa.Array, owner: np.ndarray, cable: np.ndarray, place: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        """Sums of cable by group, place and kind; a place that is a voxel outside the grid is null."""
        outside = 1 if self.volume is None else 0
        width = (int(place.max(initial=-1)) + 1 + outside) * 6
        key = owner * width + (place + outside).astype(np.int64) * 6 + kind
        kept, sums, _ = self._summed(key, len(files) * width, cable, None)
        place = kept % max(width, 1) // 6 - outside
        named = pa.array(place, pa.int64(), mask=place < 0) if self.volume is None else pa.array(self.volume.names[place], pa.int64())
        return self._batch(files, kept // max(width, 1), named, False, kept % 6, sums, np.zeros(len(kept), np.int64))

    def _ends(self, files: pa.Array, owner: np.ndarray, region: pa.ChunkedArray, kind: np.ndarray, cable: np.ndarray, termini: np.ndarray) -> pa.RecordBatch:
        coded = pc.dictionary_encode(region.combine_chunks(), null_encoding="encode")
        width = max(len(coded.dictionary), 1) * 6
        key = owner * width + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 6 + kind
        kept, sums, ends = self._summed(key, len(files) * width, cable, termini)
        named = coded.dictionary.take(pa.array(kept % width // 6)).cast(pa.int64())
        return self._batch(files, kept // width, named, True, kept % 6, sums, ends.astype(np.int64))

    @staticmethod
    def _summed(key: np.ndarray, size: int, cable: np.ndarray, termini: np.ndarray | None):
        """Keys that occur, and sums over them."""
        if size <= PLAIN_SUMS:
            kept, code, width = np.flatnonzero(np.bincount(key, minlength=size)), key, size
        else:
            kept, code = np.unique(key, return_inverse=True)
            width = len(kept)
        pick = (lambda x: x[kept]) if size <= PLAIN_SUMS else (lambda x: x)
        return kept, pick(np.bincount(code, cable, width).astype(float)), None if termini is None else pick(np.bincount(code, termini, width))

    @staticmethod
    def _batch(files: pa.Array, owner: np.ndarray, place: pa.Array, end: bool, kind: np.ndarray, cable: np.ndarray, termini: np.ndarray) -> pa.RecordBatch:
        columns = [
            files.take(pa.array(owner)), place, pa.array(np.full(len(kind), end)), pa.array(SIDES[kind // 2]), pa.array(COMPARTMENTS[kind % 2]),
            pa.array(cable), pa.array(termini),
        ]
        return pa.RecordBatch.from_arrays(columns, ["file_id", "place", "_end", "side", "compartment", "cable", "termini"])
