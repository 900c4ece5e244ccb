"""Helpers of this package: whole columns of text as byte arrays, word positions, names that cannot clash."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20

#: ASCII white space 09-0D and 20, the separators of the word patterns that take everything else.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes with A-Z folded to a-z; bytes of other UTF-8 characters stay.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[0x41:0x5B] += 0x20


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns as one struct, so that an operator's own column names cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: Sequence[str], results: Sequence[str], name: str = "row") -> DataFrame:
    """The struct's columns and the results; a result replaces an input column of its name."""
    kept = [c for c in columns if c.lower() not in {r.lower() for r in results}]
    return df.select(*[F.col(name).getField(c).alias(c) for c in kept], *results)


def with_results(row: DataFrame, results: str) -> T.StructType:
    """Schema of the packed rows followed by an operator's results."""
    return T.StructType([row.schema["row"], *T.StructType.fromDDL(results).fields])


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Let no Arrow batch of this session grow beyond ``size`` bytes; by rows alone a batch of long texts has no bound."""
    spark.conf.set(BATCH_KEY, str(size))


def hand_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run):
    """The same generator function, which hands freed memory back to the system when a task is done.

    Workers serve one task after another; what tokenizers and long texts leave in the heap would add up beside the JVM.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            hand_back()

    return task


def frugal_group(run):
    """The same function of a group's table, or of a cogroup's two, which hands freed memory back after every group."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            hand_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            hand_back()

    # Spark tells a cogroup and a key by the number of arguments
    return two if run.__code__.co_argcount == 2 else one


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: what decides into how many parts the work is cut."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by one space, and the n + 1 places where texts begin. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    _, offsets, data = joined.buffers()
    begins = np.frombuffer(offsets, dtype=np.int64)[joined.offset: joined.offset + len(joined) + 1]
    if not len(begins):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[begins[0]: begins[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, begins - begins[0]


def slices(table: pa.Table | pa.RecordBatch, sizes: pa.Array | pa.ChunkedArray, each: int) -> Iterable:
    """The rows in order, cut so that a slice holds about ``each`` bytes, one row at least."""
    total = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + each, "right")))
        yield table.slice(at, end - at)
        at = end


def word_spans(data: np.ndarray, begins: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 ordinals of each text's first word. Every text ends in a gap."""
    edge = np.diff(gaps[data].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, ends, np.searchsorted(starts, begins)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word is hashed once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    solid = np.ascontiguousarray(data[~gaps[data]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    coded = pc.dictionary_encode(words)
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
