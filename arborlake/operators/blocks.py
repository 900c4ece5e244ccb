"""Volumes as blocks: one row per cube of 32 voxels a side, with an array per value.

A voxel of a node is a block and a place in its array. Joining on blocks moves a volume once, whatever the number of its
voxels: an atlas of 10^9 voxels is some 36,000 rows. Neighbourhoods are worked on in the same cubes with their rims, so a
stencil needs one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import session as joins
from ..model import Grid, pack_voxel
from ..session import lookup_join, settle

SIDE = 32
CELLS = SIDE**3


def block_of(grid: Grid, key: Column | str) -> tuple[Column, Column]:
    """Block and place inside it of a linear voxel number."""
    key = F.col(key) if isinstance(key, str) else key
    _, nb, nc = grid.shape
    axes = F.floor(key / (nb * nc)), F.pmod(F.floor(key / nc), F.lit(nb)), F.pmod(key, F.lit(nc))
    block = F.when(key.isNotNull(), pack_voxel(*[F.floor(v / SIDE) for v in axes]))
    place = [F.pmod(v, F.lit(SIDE)) for v in axes]
    return block, ((place[0] * SIDE + place[1]) * SIDE + place[2]).cast("int")


@dataclass(frozen=True)
class BlockVolume:
    """``table`` has (block, and an array per name of ``values``); a place without a voxel is null."""

    table: DataFrame
    grid: Grid
    values: tuple[str, ...]

    def settled(self) -> BlockVolume:
        """Written once, for many joins."""
        return BlockVolume(settle(self.table), self.grid, self.values)


def block_volume(volume: DataFrame, grid: Grid, key: str, values: Sequence[str]) -> BlockVolume:
    """Cut a volume with one row per voxel (a linear voxel number and its values) into blocks."""
    values = tuple(values)
    block, place = block_of(grid, key)
    rows = volume.select(block.alias("block"), place.alias("place"), *values)
    kinds = [T.StructField(v, T.ArrayType(volume.schema[v].dataType)) for v in values]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}
    kind = {v: arrow[volume.schema[v].dataType.simpleString()] for v in values}

    def dense(cells: pa.Table) -> pa.Table:
        # a place takes the row that fills it; a null value stays null
        order = np.full(CELLS, -1, np.int64)
        order[cells.column("place").to_numpy()] = np.arange(cells.num_rows)
        picked = pa.array(order, mask=order < 0)
        lists = [pa.ListArray.from_arrays(pa.array([0, CELLS], pa.int32()), cells.column(v).combine_chunks().take(picked).cast(kind[v])) for v in values]
        return pa.Table.from_arrays([cells.column("block").slice(0, 1).combine_chunks(), *lists], ["block", *values])

    schema = T.StructType([T.StructField("block", T.LongType()), *kinds])
    return BlockVolume(rows.groupBy("block").applyInArrow(dense, schema), grid, values)


def at_voxels(rows: DataFrame, key: str, volume: DataFrame | BlockVolume, grid: Grid, values: Sequence[str], salt_by: Sequence[str] | None = None,
              summary: DataFrame | None = None) -> DataFrame:
    """``rows`` with the volume's ``values`` at the linear voxel ``key``, null where there is none.

    A sparse volume has (``key``, values), one row per voxel; it is broadcast if its counted size allows. Otherwise, and for a
    volume that is in blocks already, blocks are joined and the values read from their arrays. ``summary`` is a cheaper frame with
    the column ``key`` in which crowded blocks are looked for.
    """
    values = list(values)
    if isinstance(volume, DataFrame):
        if joins.fits_broadcast(volume):
            return rows.join(F.broadcast(volume.select(key, *values)), key, "left")
        volume = block_volume(volume, grid, key, values)
    block, place = block_of(grid, key)
    names = {v: f"_cells_{v}" for v in values}
    table = volume.table.select(F.col("block").alias("_block"), *[F.col(v).alias(names[v]) for v in values])
    if summary is not None:
        summary = summary.select(block.alias("_block"))
    met = lookup_join(rows.withColumns({"_block": block, "_place": place}), table, "_block", "left", salt_by=salt_by, check=False, summary=summary, salt_all=False)
    read = {v: F.when(F.col("_place").isNotNull(), F.get(F.col(names[v]), F.col("_place"))) for v in values}
    return met.withColumns(read).drop("_block", "_place", *names.values())
