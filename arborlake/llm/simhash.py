"""SimHash near-dedup: fingerprints, links within a Hamming radius, connected groups.

Only distinct fingerprints are compared, so a group of copies counts once. Two fingerprints that differ in at most
``radius`` of 64 bits agree on at least ``radius`` of any ``2 * radius`` blocks: each choice of blocks makes one
table, and fingerprints that share a key of a table meet. A key that more than ``MEMBERS`` fingerprints share is
refined by the same rule on the bits outside it, which loses no link and bounds a group by the number of patterns
that are left. Inside a group the bits stand vertically: plane b holds bit b of 64 fingerprints per word, one exclusive
or compares 64 pairs at a time, carry-save counters add up the differences, and words whose pairs have all passed the
radius are dropped from the rest of the planes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import settle
from .common import FOLDED, SPACES, bounded_batches, flat, same, slices, word_spans

SEED = 42
MEMBERS = 4096
SLICE_BYTES = 4 << 20


# -- fingerprints ----------------------------------------------------------------------------------------------------


def shingle_hashes(texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 hashes of all shingles in the order of the texts, repeats included, and the number of shingles per text."""
    data, begins = flat(texts)
    data = FOLDED[data]
    starts, ends, first = word_spans(data, begins, SPACES)
    # words side by side with single spaces, so that a shingle is one run of bytes
    size = ends - starts + 1
    cover = np.zeros(len(data) + 1, np.int8)
    cover[starts] += 1
    cover[ends + 1] -= 1
    data[ends] = 0x20
    line = memoryview(data[np.cumsum(cover[:-1], dtype=np.int8).astype(bool)].tobytes())
    at = np.concatenate([[0], np.cumsum(size)])
    words = np.diff(first)
    count = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    until = np.minimum(begin + shingle, np.repeat(first[1:], count))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[until] - 1).tolist())), np.uint64, len(begin))
    return hashes, count


def fingerprints_of(texts, shingle: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    hashes, count = shingle_hashes(texts, shingle)
    out = np.zeros(len(count), np.uint64)
    filled = np.flatnonzero(count)
    if len(filled):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.concatenate([[0], np.cumsum(count[filled])])
        sums = np.empty((len(filled), 64), np.int64)
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            sums[k] = bits[a:b].sum(axis=0, dtype=np.int64)
        major = (2 * sums > count[filled][:, None]).astype(np.uint8)
        out[filled] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column("text")), SLICE_BYTES):
                found = fingerprints_of(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprint(shingle), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


# -- pairs within the radius -----------------------------------------------------------------------------------------


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words + 1) planes; bit i of plane b is bit b of fingerprint i; the last word is empty."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n + 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _shifted(plane: np.ndarray, d: int) -> np.ndarray:
    """Bit i of the result is bit i + d of the plane."""
    q, r = divmod(d, 64)
    out = np.zeros(plane.shape[-1] - 1, np.uint64)
    a = plane[q:]
    m = min(len(a), len(out))
    out[:m] = a[:m] >> np.uint64(r)
    if r:
        m = min(len(a) - 1, len(out))
        out[:m] |= a[1: m + 1] << np.uint64(64 - r)
    return out


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Pairs whose counter is above the radius, compared bit by bit from the highest."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if not radius >> k & 1:
            above |= equal & counters[k]
            equal &= ~counters[k]
        else:
            equal &= counters[k]
    return above


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs with equal keys and at most ``radius`` different bits. Rows are sorted by key."""
    left, right = [], []
    rows = np.arange(len(keys))
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else rows
    size = np.diff(np.concatenate([cut, [len(keys)]]))
    d, depth = 1, radius.bit_length()
    while len(size) and size.max() > d:
        # rows of groups that still have pairs d apart, laid out anew whenever half of them are done
        alive = np.repeat(size > d, size)
        rows, size = rows[alive], size[size > d]
        group, planes = np.repeat(np.arange(len(size)), size), _planes(fps[rows])
        enough = len(rows) // 2
        while size.max() > d and size[size > d].sum() > enough:
            pair = np.zeros((planes.shape[1] - 1) * 64, np.uint8)
            pair[: len(rows) - d] = group[d:] == group[:-d]
            live = np.packbits(pair, bitorder="little").view("<u8")
            at = np.flatnonzero(live)
            live = live[at]
            counters = [np.zeros(len(at), np.uint64) for _ in range(depth)]
            for b in range(64):
                carry = (planes[b, :-1] ^ _shifted(planes[b], d))[at]
                for k in range(depth):
                    counters[k], carry = counters[k] ^ carry, counters[k] & carry
                live = live & ~carry
                if b % 8 == 7:
                    live &= ~_beyond(counters, radius)
                    keep = live != 0
                    if not keep.any():
                        at = at[:0]
                        break
                    if 2 * keep.sum() < len(keep):
                        at, live, counters = at[keep], live[keep], [c[keep] for c in counters]
            if len(at):
                word, bit = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                i = at[word] * 64 + bit
                left.append(rows[i])
                right.append(rows[i + d])
            d += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch waits for the next one."""

        def links(k, f):
            i, j = close_pairs(k, f.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(f[i]), pa.array(f[j])], ["src", "dst"])

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            k, f = (batch.column(c).to_numpy() for c in ("key", "fp"))
            if not len(k):
                continue
            if k[0] == k[-1] and waiting and waiting[0][0][0] == k[0]:
                waiting.append((k, f))
                continue
            cut = int(np.searchsorted(k, k[-1]))
            keys, fps = (np.concatenate(x) for x in zip(*waiting, (k[:cut], f[:cut])))
            if len(keys):
                yield links(keys, fps)
            waiting = [(k[cut:], f[cut:])]
        if waiting:
            yield links(*(np.concatenate(x) for x in zip(*waiting)))

    return run


def _tables(blocks: list[tuple[int, int]], choose: int) -> list[int]:
    """Masks of all choices of blocks, each block given as (lowest bit, width)."""
    return [sum(((1 << w) - 1) << at for at, w in chosen) for chosen in combinations(blocks, choose)]


def _blocks(bits: list[int], n: int) -> list[int]:
    """The bit positions cut into n blocks, each as a mask."""
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def _masks(free: list[int], radius: int) -> list[int]:
    return [sum(c) for c in combinations(_blocks(free, 2 * radius), radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(rows: DataFrame, masks: list[int], salt: int) -> DataFrame:
    """One row per table: the key is the hash of the table's number and the bits under its mask."""
    tables = F.array(*[F.struct(F.lit(salt + n).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for n, m in enumerate(masks)])
    return rows.select("fp", *[c for c in rows.columns if c != "fp"], F.explode(tables).alias("k"))


def links(distinct: DataFrame, radius: int = 2, members: int = MEMBERS) -> DataFrame:
    """(src, dst) of distinct fingerprints that differ in at most ``radius`` bits; a pair may come more than once.

    A key is the hash of (table, bits), so two keys may meet by chance; that costs a comparison and adds no link.
    """
    if radius < 1:
        return distinct.sparkSession.createDataFrame([], "src long, dst long")
    masks = _masks(list(range(64)), radius)
    coarse = _keyed(distinct.select("fp"), masks, 0).select(F.xxhash64("k.t", "k.part").alias("key"), F.col("k.t").alias("t"), "fp")
    sizes = settle(coarse.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = coarse.join(sizes, "key")
    small = met.filter(F.col("n") <= members).select("key", "fp")
    frames = [small]
    if sizes.filter(F.col("n") > members).limit(1).count():
        crowded = met.filter(F.col("n") > members)
        for n, mask in enumerate(masks):
            free = [b for b in range(64) if not mask >> b & 1]
            finer = _keyed(crowded.filter(F.col("t") == n).select("fp", "key"), _masks(free, radius), 0)
            frames.append(finer.select(F.xxhash64("key", "k.t", "k.part").alias("key"), "fp"))
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(radius), "src long, dst long")


# -- groups ----------------------------------------------------------------------------------------------------------


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, radius: int = 2, members: int = MEMBERS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are ``shingle`` words joined by one space, repeats
    included; a text with fewer words has one shingle of all its words. Bit b of the fingerprint is set if bit b is set
    in over half of the shingles' XXH64 hashes (seed 42). Fingerprints link at ``radius`` or fewer different bits;
    ``component_id`` is the smallest id that links reach. The fingerprint is written as 16 lowercase hex digits.

    Defined results: very long texts are fingerprinted whole, where they are read;
    null, empty and blank texts have fingerprint zero and link like any other; repeated rows are one
    fingerprint; rows whose id is null take part, and a group of nothing else has a null component_id; an empty table
    gives an empty table; other columns are not read.
    """
    slim = settle(fingerprints(docs, text, id_col, shingle))
    distinct = settle(slim.groupBy("fp").agg(F.min("doc_id").alias("low")))
    pairs = settle(links(distinct, radius, members))
    linked = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    groups = connected_components(linked, pairs)
    named = distinct.join(groups.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = settle(named)
    lowest = settle(named.groupBy("component").agg(F.min("low").alias("component_id")))
    table = settle(named.join(lowest, "component").select("fp", "component_id"))
    return slim.join(table, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of every group: the one whose id is the component_id.

    Defined results: rows that repeat an id are one document, of which one row stays; rows without an id stay unless
    their group has a document with one.
    """
    groups = settle(groups)
    gone = settle(groups.filter(~same(F.col("doc_id"), F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct())
    kept = docs.join(gone, same(docs[id_col], gone["_id"]), "left_anti")
    twice = settle(groups.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id"))
    if not twice.limit(1).count():
        return kept
    once = kept.join(twice, kept[id_col] == twice["_id"], "left_anti")
    return once.unionByName(kept.join(twice, kept[id_col] == twice["_id"], "left_semi").dropDuplicates([id_col]))
