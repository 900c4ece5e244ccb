"""Substring dedup: words inside a window of words that occurs anywhere else are removed.

Every window of ``window`` consecutive words gets two Rabin-Karp hashes of 64 bits. Documents are dealt into parts
of bounded size. A part sends each of its distinct window hashes once, cut by the second hash into buckets; a bucket
counts in how many parts a hash occurs and answers with one bit per hash. Back in its part, a window is repeated if
its bit is set or if it occurs twice inside the part. Repeated windows merge into maximal intervals of words.

A passage that a third of all documents share travels once per part, not once per document, so no bucket grows with
the number of its copies. Text is shuffled once: both visits of a part read the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, bounded_batches, flat, frugal_group, packed, parts_for, text_bytes, unpacked, with_results, word_codes, word_spans

#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PART_BYTES = 4 << 20
RESULTS = ("n_words", "n_removed", "kept_text", "removed_spans")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a product over all bits, in place (the finaliser of splitmix64)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def rolling(codes: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``window`` codes, modulo 2**64.

    The prefix sums of code[i] * base**i give each window by one subtraction; multiplying by the inverse power
    (the base is odd) makes equal windows equal wherever they stand.
    """
    n = len(codes)
    if n < window:
        return np.zeros(0, np.uint64)
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    prefix = np.zeros(n + 1, np.uint64)
    np.multiply(codes, powers, out=prefix[1:])
    np.cumsum(prefix[1:], out=prefix[1:])
    powers[0], powers[1:] = 1, pow(base, -1, 1 << 64)
    np.cumprod(powers, out=powers)
    found = prefix[window:] - prefix[:-window]
    found *= powers[: n - window + 1]
    return _mixed(found)


class Windows:
    """The windows of one part: their first words and their distinct hashes in (bucket, hash) order.

    Arrays as long as the words are what a worker holds beside the JVM: places are 32 bits wide and nothing stays that is not read.
    """

    def __init__(self, texts, window: int, buckets: int):
        self.data, self.begins = flat(texts)
        self.starts, self.ends, self.first = word_spans(self.data, self.begins, SPACES)
        n = len(self.starts)
        place = np.int32 if n < 1 << 31 else np.int64
        codes = word_codes(self.data, self.starts, self.ends, SPACES)
        # a window starts at all words of a text but its last ones
        opens = np.zeros(n + 1, np.int8)
        whole = np.diff(self.first) >= window
        np.add.at(opens, self.first[:-1][whole], 1)
        np.add.at(opens, self.first[1:][whole] - window + 1, -1)
        starts = np.cumsum(opens[:n], dtype=np.int8).astype(bool)[: max(n - window + 1, 0)]
        low = rolling(codes, window, BASES[0])[starts]
        high = rolling(codes, window, BASES[1])[starts]
        del codes
        bucket = (high % np.uint64(buckets)).astype(np.uint32)
        del high
        order = np.lexsort((low, bucket)).astype(place)
        low, bucket = low[order], bucket[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])
        self.hashes, self.bucket = low[new], bucket[new]
        #: First words of the windows in the order of their hashes, and the ordinals of these.
        self.at, self.ordinal = np.flatnonzero(starts).astype(place)[order], np.cumsum(new, dtype=place) - place(1)

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1)) if len(self.bucket) else np.zeros(0, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(self.bucket)]):
            yield int(self.bucket[a]), int(a), int(b)


def _fingerprint(window: int, buckets: int, text: str):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        found = Windows(table.column("row").combine_chunks().field(text), window, buckets)
        rows = [(bucket, found.hashes[a:b].tobytes()) for bucket, a, b in found.by_bucket()]
        return pa.table({
            "part": pa.array([part] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "hashes": pa.array([r[1] for r in rows], pa.binary()),
        })

    return run


def _count(table: pa.Table) -> pa.Table:
    """One bucket: which hashes stand in two rows or more, as one bit per hash of each row that has any."""
    blobs = table.column("hashes").to_pylist()
    sizes = np.array([len(b) // 8 for b in blobs])
    hashes = np.frombuffer(b"".join(blobs), np.uint64)
    order = np.argsort(hashes)
    ordered = hashes[order]
    equal = ordered[1:] == ordered[:-1]
    del ordered
    again = np.zeros(len(hashes), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    bits, ends = [], np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends):
        bits.append(np.packbits(again[a:b]).tobytes() if again[a:b].any() else None)
    keep = np.array([b is not None for b in bits], bool)
    return pa.table({
        "part": table.column("part"), "bucket": table.column("bucket"), "again": pa.array(bits, pa.binary()),
    }).filter(pa.array(keep))


def _sums(values: np.ndarray, first: np.ndarray, kind: type) -> np.ndarray:
    """Sums of the words of each text."""
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, dtype=kind, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _remove(window: int, buckets: int, text: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.column("row").combine_chunks()
        found = Windows(rows.field(text), window, buckets)
        repeated = np.bincount(found.ordinal, minlength=len(found.hashes)) > 1
        bits = dict(zip(right.column("bucket").to_pylist(), right.column("again").to_pylist()))
        for bucket, a, b in found.by_bucket():
            if bucket in bits:
                repeated[a:b] |= np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a).astype(bool)
        n, starts, ends, data = len(found.starts), found.starts, found.ends, found.data.copy()
        first, hit = found.first, found.at[repeated[found.ordinal]]
        del found, repeated
        edge = np.zeros(n + 1, np.int32)
        edge[hit] += 1
        edge[hit + window] -= 1
        gone = np.cumsum(edge[:n], dtype=np.int32) > 0
        del edge, hit
        words = np.diff(first)
        removed = _sums(gone, first, np.int32 if n < 1 << 31 else np.int64)

        data[ends] = 0x20
        cover = np.zeros(len(data) + 1, np.int8)
        cover[starts[~gone]] += 1
        cover[ends[~gone] + 1] -= 1
        np.cumsum(cover, out=cover)
        kept = data[cover[:-1].view(bool)].tobytes()
        size = np.concatenate([[0], np.cumsum(_sums(np.where(gone, 0, ends - starts + 1), first, np.int64))])
        del data, cover, starts, ends
        texts = [kept[a:max(a, b - 1)] for a, b in zip(size[:-1].tolist(), size[1:].tolist())]

        # runs of gone words, cut where a text ends
        opens = np.zeros(n + 1, bool)
        opens[first] = True
        turn = np.flatnonzero(gone & (opens[:n] | ~np.concatenate([[False], gone[:-1]])))
        stop = np.flatnonzero(gone & (opens[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
        inside = first[np.searchsorted(first, turn, "right") - 1]
        span = pa.StructArray.from_arrays([pa.array(turn - inside, pa.int64()), pa.array(stop - inside, pa.int64())], names=["first", "end"])
        offsets = pa.array(np.searchsorted(turn, first), pa.int32())
        return pa.table({
            "row": rows, "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "removed_spans": pa.ListArray.from_arrays(offsets, span),
        })

    return run


def dedup_substrings(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 35, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed, kept_text and removed_spans.

    A word is ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``window`` words that covers it starts
    anywhere else too, in the same or another row; all windows are judged on the input. ``kept_text`` holds the words
    that stay, joined by one space; ``removed_spans`` the maximal intervals (first, end) of word ordinals that go.

    Defined results: very long texts are windowed whole;
    a null or empty text has no words and an empty ``kept_text``; a text shorter than the window
    keeps all words; repeated rows are rows of their own, so their long windows are repeated; null ids are ids like
    any other; other columns pass through unless a result has their name; an empty table gives an empty table.

    Two different windows are taken for equal only if 64 bits of one hash and the bucket of another agree. With
    buckets of about a million windows that is expected once in some 10**13 windows, at any size of input.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = parts_for(spark, text_bytes(docs, text), part_bytes)
    row = packed(docs)
    key = F.pmod(F.xxhash64(F.col("row").getField(id_col), F.col("row").getField(text)), F.lit(parts)).cast("int")
    staged = row.withColumn("part", key)
    sent = staged.groupBy("part").applyInArrow(frugal_group(_fingerprint(window, parts, text)), "part int, bucket int, hashes binary")
    again = sent.groupBy("bucket").applyInArrow(frugal_group(_count), "part int, bucket int, again binary")
    kind = with_results(row, "n_words long, n_removed long, kept_text string, removed_spans array<struct<first:long,end:long>>")
    out = staged.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(frugal_group(_remove(window, parts, text)), kind)
    return unpacked(out, docs.columns, RESULTS)
