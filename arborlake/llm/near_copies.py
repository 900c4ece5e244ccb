"""Near copies by the Jaccard similarity of their shingle sets.

Candidates come from minwise hashing: two texts meet when all ``ROWS`` minima of one of ``BANDS`` bands agree. A pair of
similarity s does so with probability 1 - (1 - s^ROWS)^BANDS; at 0.8 three pairs in a million do not meet, above it fewer.
Every link is confirmed on the whole sets, so no pair below the threshold is linked. Equal sets are one member.

Before sets are looked at, parities decide: every shingle falls into one of ``CLASSES`` and one bit says whether a class holds an
odd number, so two sets differ in at least as many shingles as bits. A pair with more bits than the threshold allows is done.

Members of a key are first compared with one leader. Where all members of a key are then in one component nothing can be
added, so a large group of near copies costs a comparison per member, not per pair. Keys that still hold several
components compare with a second leader. In what is left the sets of a key come together once: its parities stand as vertical
bit planes, each member is compared with 64 others by one exclusive or per plane, carry-save counters add up the
differences and words whose pairs have all passed their radius are abandoned. Only pairs that survive and are not yet connected
are confirmed, so a key yields fewer links than it has members. A key that more than ``MEMBERS`` share is refined by
``BANDS`` further bands of rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import connected_components
from ..session import fits_broadcast, settle
from .common import bounded_batches, frugal, slices
from .simhash import SLICE_BYTES, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
LEADERS = 2
CLASSES = 1024
MEMBERS = 4096
#: Groups up to this size are compared row by row, larger ones in bit planes; rows of a group that are compared at once.
FEW = 64
ABREAST = 64

_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS * 2, np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(hashes: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    cuts = np.concatenate([[0], np.cumsum(count)])
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``CLASSES`` bits per set, as signed longs."""
    shift = np.uint64(64 - CLASSES.bit_length() + 1)
    odd = [np.packbits((np.bincount((s >> shift).astype(np.int64), minlength=CLASSES) & 1).astype(np.uint8)) for s in sets]
    return np.concatenate([*odd, np.zeros(0, np.uint8)]).view(np.int64)


def _band_keys(hashes: np.ndarray, count: np.ndarray, level: int = 0) -> np.ndarray:
    """``BANDS`` keys per set, one after the other; a level has rows of its own."""
    minima = np.zeros((len(count), BANDS * ROWS), np.uint64)
    filled = np.flatnonzero(count)
    if len(filled):
        begin = np.concatenate([[0], np.cumsum(count[filled])[:-1]])
        for k, factor in enumerate(_FACTORS[level * BANDS * ROWS: (level + 1) * BANDS * ROWS]):
            minima[filled, k] = np.minimum.reduceat(hashes * factor, begin)
    bands = minima.reshape(-1, BANDS, ROWS)
    keys = [xxhash.xxh3_64_intdigest(band.tobytes(), seed=b) for row in bands for b, band in enumerate(row)]
    return np.array(keys, np.uint64).view(np.int64)


def _lists(values: np.ndarray, n: int, each: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), pa.array(values))


def _describe(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hash and size of the set of shingles (zero for texts without words), a key per band, and the parities."""
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column("text")), SLICE_BYTES):
                hashes, count = shingle_hashes(part.column("text"), shingle)
                sets = _sets(hashes, count)
                code = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_code"), pa.array(code.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                    _lists(_band_keys(hashes, count), len(count), BANDS), _lists(_parities(sets), len(count), CLASSES // 64),
                ], ["doc_id", "text_code", "code", "n", "keys", "odd"])

    return run


def _whole(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column("text")), SLICE_BYTES):
                sets = _sets(*shingle_hashes(part.column("text"), shingle))
                yield pa.RecordBatch.from_arrays([part.column("code"), pa.array([s.tobytes() for s in sets], pa.binary())], ["code", "items"])

    return run


def _confirm(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both >= similarity * (len(x) + len(y) - both) * (1 - 1e-12))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the second level of every set."""
    for batch in batches:
        items = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column("items")]
        keys = _band_keys(np.concatenate([*items, np.zeros(0, np.uint64)]), np.array([len(i) for i in items], np.int64), 1)
        yield pa.RecordBatch.from_arrays([batch.column("code"), _lists(keys, len(items), BANDS)], ["code", "finer"])


class _Group:
    """Members that stand side by side, with their parities, sets and components; links are found once per component."""

    def __init__(self, code, n, odd, items, component, similarity):
        self.code, self.n, self.odd, self.items, self.similarity = code, n, odd.view(np.uint64), items, similarity
        labels, self.component = np.unique(component, return_inverse=True)
        self.parent = np.arange(len(labels))
        self.links: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def _radius(self, a, b):
        return np.floor((self.n[a] + self.n[b]) * ((1 - self.similarity) / (1 + self.similarity)) + 1e-6).astype(np.int64)

    def _near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        near = (low >= self.similarity * (1 - 1e-12) * high) & (self.component[i] != self.component[j])
        at = np.flatnonzero(near)
        near[at] = np.bitwise_count(self.odd[i[at]] ^ self.odd[j[at]]).sum(axis=1, dtype=np.int64) <= self._radius(i[at], j[at])
        return near

    def confirm(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link the pairs that are similar, unless they are connected by now."""
        near = self._near(i, j)
        for a, b in zip(i[near].tolist(), j[near].tolist()):
            p, q = self._find(self.component[a]), self._find(self.component[b])
            if p != q:
                both = len(np.intersect1d(self.items[a], self.items[b], assume_unique=True))
                if both >= self.similarity * (self.n[a] + self.n[b] - both) * (1 - 1e-12):
                    self.parent[max(p, q)] = min(p, q)
                    self.links.append((a, b))

    def connected(self, at: int, until: int) -> bool:
        return len({self._find(c) for c in np.unique(self.component[at:until]).tolist()}) == 1

    def few(self, begin: np.ndarray, size: np.ndarray) -> None:
        """Groups of a few members: all pairs that stand d apart at a time."""
        for d in range(1, int(size.max(initial=1))):
            long = size > d
            count = size[long] - d
            first = np.repeat(begin[long] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            self.confirm(first, first + d)

    def many(self, at: int, until: int) -> None:
        """One large group in bit planes: a strip of members against all that follow, 64 to a word."""
        size = until - at
        words = -(-size // 64)
        bits = np.zeros((words * 64, CLASSES), np.uint8)
        bits[:size] = np.unpackbits(np.ascontiguousarray(self.odd[at:until]).view(np.uint8).reshape(size, -1), axis=1, bitorder="little")
        planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
        largest = np.maximum.reduceat(self.n[at:until], np.arange(0, size, 64))
        depth = CLASSES.bit_length()
        for low in range(0, size - 1, ABREAST):
            if self.connected(at, until):
                return
            rows = np.arange(low, min(low + ABREAST, size))
            here = np.arange(low // 64, words)
            most = np.floor((self.n[at + rows][:, None] + largest[here][None, :]) * ((1 - self.similarity) / (1 + self.similarity)) + 1e-6).astype(np.int64)
            own = -bits[rows].astype(np.int64).T.astype(np.int64)  # all ones where the member's bit is set
            live = np.full(most.shape, ~np.uint64(0))
            counters = [np.zeros(most.shape, np.uint64) for _ in range(depth)]
            for b in range(CLASSES):
                carry = planes[b, here][None, :] ^ own[b].view(np.uint64)[:, None]
                for k in range(depth):
                    counters[k], carry = counters[k] ^ carry, counters[k] & carry
                    if not k & 3 and not carry.any():
                        break
                if b % 64 == 63:
                    live &= ~_passed(counters, most)
                    keep = live.any(axis=0)
                    if not keep.any():
                        break
                    if 2 * keep.sum() < len(keep):
                        here, most, live, counters = here[keep], most[:, keep], live[:, keep], [c[:, keep] for c in counters]
            if len(here) and live.any():
                left = np.unpackbits(np.ascontiguousarray(live).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
                i, j = np.nonzero(left)
                i, j = rows[i], here[j // 64] * 64 + j % 64
                after = (j > i) & (j < size)
                self.confirm(at + i[after], at + j[after])


def _passed(counters: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Pairs whose counter is above the radius of their word, bit by bit from the highest."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for k in reversed(range(len(counters))):
        one = np.where(most >> k & 1, ~np.uint64(0), np.uint64(0))
        above |= equal & counters[k] & ~one
        equal &= ~(counters[k] ^ one)
    return above


def _connect(similarity: float):
    def links(rows: pa.Table) -> pa.RecordBatch:
        keys = rows.column("key").to_numpy()
        odd = pa.concat_arrays(rows.column("odd").chunks).flatten().to_numpy().reshape(len(keys), -1)
        items = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("items")]
        code = rows.column("code").to_numpy()
        group = _Group(code, rows.column("n").to_numpy(), odd, items, rows.column("component").to_numpy(), similarity)
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([begin, [len(keys)]]))
        group.few(begin[size <= FEW], size[size <= FEW])
        for at, length in zip(begin[size > FEW].tolist(), size[size > FEW].tolist()):
            group.many(at, at + length)
        ends = np.array(group.links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(code[ends[:, 0]]), pa.array(code[ends[:, 1]])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch waits for the next one."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            if not len(keys):
                continue
            if waiting and keys[0] == keys[-1] == waiting[-1].column("key")[-1].as_py():
                waiting.append(batch)
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            done = [b for b in [*waiting, batch.slice(0, cut)] if b.num_rows]
            if done:
                yield links(pa.Table.from_batches(done))
            waiting = [batch.slice(cut)]
        if waiting:
            yield links(pa.Table.from_batches(waiting))

    return run


def _long_enough(a: Column, b: Column, similarity: float) -> Column:
    """Sets of these sizes can reach the similarity."""
    return F.least(a, b) >= similarity * (1 - 1e-12) * F.greatest(a, b)


def _inside(left: DataFrame, whole: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """Links between the components that meet in a key."""
    crowded = settle(left.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > crowd).select("key"))
    rows = left
    if crowded.limit(1).count():
        crowd_rows = settle(left.join(crowded, "key", "left_semi"))
        inside = whole.join(crowd_rows.select("code").distinct(), "code", "left_semi").select("code", "items")
        finer = settle(inside.mapInArrow(_finer, "code long, finer array<long>"))
        refined = crowd_rows.join(finer, "code").select(F.col("key").alias("above"), "code", "n", "component", F.posexplode("finer"))
        refined = refined.select(F.xxhash64("above", "pos", "col").alias("key"), "code", "n", "component")
        rows = left.join(crowded, "key", "left_anti").unionByName(refined.select(*left.columns))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.join(whole, "code").select("key", "code", "n", "component", "odd", "items")
    return met.repartition(n, "key").sortWithinPartitions("key", "n", "code").mapInArrow(frugal(_connect(similarity)), "src long, dst long")


def similar_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = MEMBERS) -> DataFrame:
    """(doc_id, component_id), one row per row of ``docs``.

    Words and shingles are those of ``near_groups``, as sets. Texts link when their sets have a Jaccard similarity of
    ``similarity`` or more; ``component_id`` is the smallest id that links reach. The bands are laid out for 0.8 and above.

    Defined results: null, empty and blank texts have no shingles and link to each other alone; repeated rows are one
    set; rows whose id is null take part, and a group of nothing else has a null component_id; very long texts are compared
    whole; an empty table gives an empty table; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_code"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    slim = settle(rows.mapInArrow(frugal(_describe(shingle)), f"doc_id {kind}, text_code long, code long, n long, keys array<long>, odd array<long>"))
    distinct = settle(slim.groupBy("code").agg(F.min("doc_id").alias("low"), F.min("text_code").alias("text_code"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd")))
    banded = distinct.filter("n > 0").select("code", "n", F.explode("keys").alias("key"))
    shared = settle(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"))
    met = settle(banded.join(shared, "key"))

    wanted = settle(met.select("code").distinct().join(distinct.select("code", "text_code", "n", "odd"), "code"))
    coded, texts = wanted.select("code", "text_code"), rows.select("text_code", "text")
    texts = texts.join(F.broadcast(coded) if fits_broadcast(coded) else coded, "text_code").dropDuplicates(["code"])
    sets = settle(texts.select("code", "text").mapInArrow(_whole(shingle), "code long, items binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (wanted.select(F.col("code").alias(end), F.col("n").alias(f"n_{end}"), F.col("odd").alias(f"odd_{end}")) for end in ("src", "dst"))
        apart = F.aggregate(F.zip_with("odd_src", "odd_dst", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, bits: total + bits)
        most = (F.col("n_src") + F.col("n_dst")) * ((1 - similarity) / (1 + similarity)) + 1e-6
        pairs = settle(pairs.join(a, "src").join(b, "dst").filter(apart <= most).select("src", "dst"))
        x = sets.select(F.col("code").alias("src"), F.col("items").alias("x"))
        y = sets.select(F.col("code").alias("dst"), F.col("items").alias("y"))
        return settle(pairs.join(x, "src").join(y, "dst").select("src", "dst", "x", "y").mapInArrow(frugal(_confirm(similarity)), "src long, dst long"))

    def ordered(pairs: DataFrame) -> DataFrame:
        fit = pairs.filter(_long_enough(F.col("n"), F.col("n2"), similarity))
        return settle(fit.select(F.least("code", "code2").alias("src"), F.greatest("code", "code2").alias("dst")).distinct())

    members = met.select(F.col("code").alias("id")).distinct()
    links, groups = None, members.select("id", F.col("id").alias("component"))
    def open_rows() -> DataFrame:
        """(key, code, n, component) of the keys that hold several components."""
        named = met.join(groups.withColumnRenamed("id", "code"), "code")
        several = settle(named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("z")).filter("a < z").select("key"))
        return settle(named.join(several, "key"))

    for turn in range(LEADERS):
        left = open_rows()
        if not left.limit(1).count():
            break
        order = F.struct(F.xxhash64("code", F.lit(turn)).alias("h"), "code", "n", "component")
        lead = left.groupBy("key").agg(F.min(order).alias("lead")).select("key", F.col("lead.code").alias("code2"), F.col("lead.n").alias("n2"), F.col("lead.component").alias("component2"))
        found = confirmed(ordered(left.join(lead, "key").filter("component <> component2")))
        links = found if links is None else settle(links.unionByName(found))
        groups = connected_components(members, links)
    left = open_rows()
    if left.limit(1).count():
        found = settle(_inside(left, wanted.join(sets, "code").select("code", "odd", "items"), similarity, crowd))
        links = found if links is None else settle(links.unionByName(found))
        groups = connected_components(members, links)

    named = distinct.select("code", "low").join(groups.withColumnRenamed("id", "code"), "code", "left")
    named = settle(named.withColumn("component", F.coalesce("component", "code")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    table = settle(named.join(lowest, "component").select("code", "component_id"))
    return slim.select("doc_id", "code").join(table, "code", "left").select("doc_id", "component_id")
