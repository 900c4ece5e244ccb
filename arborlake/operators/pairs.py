"""All-pairs products of sparse vectors as tiles of bounded size.

A pair table has a row per pair of files, so its size is set by the question. What must not happen on the way is
that one popular voxel, or one huge file, pairs up inside a single task. Files are therefore hashed into blocks,
keys into strips, and each (block, block, strip) tile is one small matrix product: its cost depends on the block
and strip sizes only, not on how often a voxel occurs. Each vector is sent once per block of partners, packed as
two arrays, instead of once per partner. Blocks grow with the number of files, up to a bound of memory, so that few
of them are met; pairs leave a tile in strips.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

FILES_PER_BLOCK = 512
KEYS_PER_STRIP = 4096
#: Files of a block of vectors at most, blocks from which they grow, and pairs that leave a tile at once. A vector is sent once per block.
MOST_FILES = 4096
BLOCKS = 16
STRIP_PAIRS = 1 << 18


def _blocks(n: int, size: int) -> int:
    return max(1, ceil(n / size))


def block_files(n: int) -> int:
    """Files of a block: as many as keep the number of blocks small, within the memory of a tile."""
    return min(max(ceil(n / BLOCKS), FILES_PER_BLOCK), MOST_FILES)


def _sided(names: Sequence[str]) -> list[str]:
    return [f"{n}_{side}" for n in names for side in ("i", "j")]


def _grid_of(table: pa.Table) -> np.ndarray:
    """The packed vectors of a tile as a dense matrix, one row per file and one column per key that occurs."""
    if not table.num_rows:
        return np.zeros((0, 1))
    keys, values = (pa.concat_arrays(table.column(c).chunks) for c in ("keys", "values"))
    column = pc.dictionary_encode(keys.flatten()).indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(table.num_rows), pc.list_value_length(keys).to_numpy(zero_copy_only=False))
    matrix = np.zeros((table.num_rows, int(column.max()) + 1 if len(column) else 1))
    matrix[row, column] = values.flatten().to_numpy(zero_copy_only=False)
    return matrix


def tiles(sent: DataFrame, keys: Sequence[str], load, measure, value: str, stats: Sequence[str] = (), dense: bool = True) -> DataFrame:
    """(i, j, value, stats of both) for i < j, one group of ``sent`` (from ``block_pairs``) per tile.

    ``load`` makes one array with a row per file from a tile's table, ``measure`` a matrix from rows of two of them. A tile is
    worked off in strips of ``STRIP_PAIRS`` pairs that leave the task as they are made. A null in ``stats`` stays null; a row of
    ``load`` that is not finite by a null gives null through the column ``_null``.
    """
    kind = sent.schema["file_id"].dataType.simpleString()
    schema = f"i {kind}, j {kind}, {value} double" + "".join(f", {n} double" for n in _sided(stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        rows, ids = load(table), pa.concat_arrays(table.column("file_id").chunks)
        order = pc.rank(ids, tiebreaker="min").to_numpy()
        own = {c: table.column(c).to_numpy() for c in ("block", "bi", "bj")}
        left, right = np.flatnonzero(own["block"] == own["bi"]), np.flatnonzero(own["block"] == own["bj"])
        same_block = own["bi"][0] == own["bj"][0]
        void = table.column("_null").to_numpy() if "_null" in table.column_names else None
        carried = {n: pa.concat_arrays(table.column(n).chunks) for n in stats}
        step = max(STRIP_PAIRS // max(len(right), 1), 1)
        for start in range(0, len(left), step):
            part = left[start: start + step]
            found = measure(rows[part], rows[right])
            keep = np.ones(found.shape, dtype=bool) if dense else found != 0
            if same_block:
                keep &= order[part][:, None] < order[right][None, :]
            a, b = np.nonzero(keep)
            first, second = part[a], right[b]
            swap = order[first] > order[second]
            first, second = np.where(swap, second, first), np.where(swap, first, second)
            mask = None if void is None else void[first] | void[second]
            ends = [pa.array(first), pa.array(second)]
            out = [ids.take(ends[0]), ids.take(ends[1]), pa.array(found[a, b], mask=mask)]
            for n in stats:
                out += [carried[n].take(end) for end in ends]
            yield pa.RecordBatch.from_arrays(out, ["i", "j", value, *_sided(stats)])

    return sent.groupBy(*keys).applyInArrow(run, schema)


def block_pairs(df: DataFrame, blocks: int) -> DataFrame:
    """Send each row to every pair of blocks its own block takes part in."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return df.withColumn("_other", other).withColumns({
        "bi": F.least("block", "_other"), "bj": F.greatest("block", "_other"),
    }).drop("_other")


def with_block(df: DataFrame, blocks: int) -> DataFrame:
    return df.withColumn("block", F.pmod(F.xxhash64("file_id"), F.lit(blocks)).cast("int"))


def all_pairs(files: DataFrame, n_files: int, block_size: int = FILES_PER_BLOCK) -> DataFrame:
    """Every unordered pair (i < j) of files with the other columns of both, by an equi-join on block pairs.

    A column ``block`` of the caller (0 … blocks-1) takes the place of the hashed one.
    """
    blocks = _blocks(n_files, block_size)
    stats = [c for c in files.columns if c not in ("file_id", "block")]
    sent = block_pairs(files if "block" in files.columns else with_block(files, blocks), blocks)
    side = lambda at, name: sent.filter(F.col("block") == F.col(at)).select(
        "bi", "bj", F.struct("file_id", *stats).alias(name)
    )
    pairs = side("bi", "a").join(side("bj", "b"), ["bi", "bj"])
    ordered = (F.col("bi") != F.col("bj")) | (F.col("a.file_id") < F.col("b.file_id"))
    flip = F.col("a.file_id") > F.col("b.file_id")
    pick = lambda name, first, second: F.when(flip, F.col(f"{second}.{name}")).otherwise(F.col(f"{first}.{name}"))
    out = [pick("file_id", "a", "b").alias("i"), pick("file_id", "b", "a").alias("j")]
    for name in stats:
        out += [pick(name, "a", "b").alias(f"{name}_i"), pick(name, "b", "a").alias(f"{name}_j")]
    return pairs.filter(ordered).select(*out)


def pair_products(
    vectors: DataFrame, stats: DataFrame | None = None, n_files: int | None = None, n_keys: int | None = None,
    complete: bool = False, block_size: int | None = None, strip_size: int = KEYS_PER_STRIP,
) -> DataFrame:
    """Σ over keys of v_i·v_j for i < j, from rows (file_id, key, value).

    ``stats`` (one row per file, double columns) is carried to both sides. ``complete`` adds the pairs without a
    shared key, with 0; otherwise they are absent. Rows without a file or key take no part.
    """
    vectors = vectors.filter("file_id IS NOT NULL AND key IS NOT NULL")
    if n_files is None or n_keys is None:
        found = vectors.agg(F.count_distinct("file_id").alias("f"), F.count_distinct("key").alias("k")).first()
        n_files, n_keys = found["f"], found["k"]
    blocks, strips = _blocks(n_files, block_size or block_files(n_files)), _blocks(n_keys, strip_size)
    names = [] if stats is None else [c for c in stats.columns if c != "file_id"]
    packed = (
        vectors.withColumn("strip", F.pmod(F.xxhash64("key"), F.lit(strips)).cast("int"))
        .groupBy("file_id", "strip").agg(F.collect_list(F.struct("key", F.col("value").cast("double").alias("value"))).alias("cells"))
        .select("file_id", "strip", F.col("cells.key").alias("keys"), F.col("cells.value").alias("values"))
    )
    if stats is not None:
        packed = packed.join(stats, "file_id")
    sent = block_pairs(with_block(packed, blocks), blocks)
    products = tiles(sent, ["bi", "bj", "strip"], _grid_of, lambda a, b: a @ b.T, "sxy", names, dense=complete and strips == 1)
    if strips == 1:
        return products
    if complete:
        files = stats if stats is not None else vectors.select("file_id").distinct()
        zero = all_pairs(files, n_files, block_size or FILES_PER_BLOCK).withColumn("sxy", F.lit(0.0))
        products = products.unionByName(zero)
    return products.groupBy("i", "j", *_sided(names)).agg(F.sum("sxy").alias("sxy"))


def mirrored(pairs: DataFrame, value: str, first: str = "i", second: str = "j") -> DataFrame:
    """Both directions of every unordered pair."""
    both = F.explode(F.array(
        F.struct(F.col(first).alias("swc_id_1"), F.col(second).alias("swc_id_2")),
        F.struct(F.col(second).alias("swc_id_1"), F.col(first).alias("swc_id_2")),
    ))
    return pairs.select(both.alias("p"), value).select("p.swc_id_1", "p.swc_id_2", value)


def symmetric_pairs(pairs: DataFrame, ids: DataFrame, value: str = "r", diagonal: float = 1.0) -> DataFrame:
    """Long square table: (i, j), (j, i) and the diagonal."""
    own = ids.select(F.col("file_id").alias("swc_id_1"), F.col("file_id").alias("swc_id_2"), F.lit(diagonal).alias(value))
    return mirrored(pairs, value).unionByName(own)
