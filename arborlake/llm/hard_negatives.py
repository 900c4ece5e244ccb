"""Hard-negative mining: largest inner products with anchors, with candidates pruned by coordinates.

Rows are sorted by length into buckets. A bucket holds, for every coordinate, its unit vectors in the order of that coordinate. An
anchor asks for inner products of at least some bound; divided by its length and the bucket's greatest length, the bound is
a cosine. Where it is above 1 the bucket has no answer. Otherwise the angle to an anchor confines each coordinate of an
answer to a range around the anchor's own; the ranges of the anchor's largest coordinates, its focus, are cut out of the
sorted lists, their candidates intersected and verified with the exact integer product.

Bounds come from a bounded sample of rows that is searched first; they decide how much is verified, never what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranks import number_rows
from ..session import forget, lookup_join, settle
from .common import bounded_batches

#: Rows of a bucket, anchors that meet it at once, and rows of the sample that gives the first bounds.
BUCKET_ROWS = 16_384
ANCHOR_ROWS = 4_096
SAMPLE = 4_096
FOCUS = 4
#: Components stop here, so that 90 times a product of up to 4,096 of them stays exact as a long.
LARGEST = 1 << 22
_EXACT = 1 << 53
_SLACK = 1e-9


def whole_components(vector: Column | str, scale: float) -> Column:
    """floor(scale * x) of every component x, as integers."""
    kept = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return F.transform(kept, lambda x: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def usable(vector: Column | str) -> Column:
    """True for vectors without a null, NaN or infinite component."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles; short ones are filled up with zeros."""
    column = column.combine_chunks()
    lists = column if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays(column.chunks)
    ends = lists.offsets.to_numpy()
    sizes, flat = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = flat[ends[0]: ends[-1]]
    return out


class Bucket:
    """Rows of similar length with a sorted list per coordinate."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.longest = norms.max(initial=0.0)
        self.units = vectors / np.where(norms > 0, norms, 1.0)[:, None]
        self.lists = {}
        # doubles add up products of integers exactly up to here; beyond it longs do
        most = np.abs(vectors).max(initial=0.0)
        self.exact = most * most * vectors.shape[1] < _EXACT

    def _sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.units[:, f], kind="stable")
            self.lists[f] = order, self.units[order, f]
        return self.lists[f]

    def candidates(self, anchor: np.ndarray, bound: float, focus: int = FOCUS) -> np.ndarray | None:
        """Places of all rows whose inner product with the anchor can reach the bound; None for all rows."""
        length = float(np.sqrt((anchor * anchor).sum()))
        if bound <= 0 or not np.isfinite(bound):
            return None
        if length * self.longest * (1 + _SLACK) < bound:
            return np.zeros(0, np.int64)
        unit = anchor / length
        reach = np.arccos(min(bound / (length * self.longest), 1.0)) + 1e-6
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:focus]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(angle + reach, np.pi)) - _SLACK, np.cos(max(angle - reach, 0.0)) + _SLACK
            order, values = self._sorted(int(f))
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            ranges.append((b - a, int(f), low, high, order[a:b]))
        ranges.sort(key=lambda r: r[0])
        found = ranges[0][-1]
        if 2 * len(found) > len(self.units):
            return None
        for _, f, low, high, _ in ranges[1:]:
            value = self.units[found, f]
            found = found[(value >= low) & (value <= high)]
        return found

    def scores(self, anchor: np.ndarray, places: np.ndarray | None) -> np.ndarray:
        rows = self.vectors if places is None else self.vectors[places]
        if self.exact and np.abs(anchor).max(initial=0.0) ** 2 * max(rows.shape[1], 1) < _EXACT:
            return np.rint(rows @ anchor).astype(np.int64)
        return rows.astype(np.int64) @ anchor.astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by falling score, then rising id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((rows[near], ids[near], -scores[near]))][:k]


def _bucket_search(width: int, k: int, alike: bool):
    """One bucket and the anchors that meet it, to the k best rows of every anchor (alike) or anchor and positive."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        # ids of null come last among equal scores
        ids = rows.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
        labels, numbers = rows.column("label").to_numpy(), rows.column("number").to_numpy()
        bucket = Bucket(_matrix(rows.column("vector"), width))
        own, asked_labels = anchors.column("number").to_numpy(), anchors.column("label").to_numpy()
        questions, bounds = _matrix(anchors.column("vector"), width), anchors.column("bound").to_numpy()
        windows = anchors.column("windows").to_pylist()
        out: list[tuple] = []
        for q in range(len(own)):
            places = bucket.candidates(questions[q], bounds[q])
            scores = bucket.scores(questions[q], places)
            places = np.arange(len(ids)) if places is None else places
            match = (labels[places] == asked_labels[q]) == alike
            match &= numbers[places] != own[q]
            places, scores = places[match], scores[match]
            for w, low, high in (window.values() for window in windows[q]):
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                best = inside[_first(scores[inside], ids[places[inside]], numbers[places[inside]], k)]
                out.append((np.full(len(best), own[q]), np.full(len(best), w), places[best], scores[best]))
        anchor, place, at, score = (np.concatenate(c).astype(np.int64) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"anchor": anchor, "place": place, "number": numbers[at], "id": rows.column("id").take(pa.array(at)), "score": score})

    return run


def _search(rows: DataFrame, anchors: DataFrame, width: int, k: int, alike: bool) -> DataFrame:
    """(anchor, place, number, id, score, rank): the k first rows in every window (place, low, high) of every anchor.

    ``rows`` has (number, id, label, vector, length, bucket); ``anchors`` has (number, label, vector, length, bound, windows), all
    scores of a window being at least the bound. Buckets meet anchors in parts of bounded size.
    """
    parts = max(-(-anchors.count() // ANCHOR_ROWS), 1)
    buckets = settle(rows.groupBy("bucket").agg(F.max("length").alias("longest")))
    last = buckets.agg(F.max("bucket")).first()[0]
    asked = anchors.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(parts)))
    # an anchor goes only to buckets that are long enough for its bound
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(last if last is not None else 0)).cast("array<long>")))
    asked = lookup_join(asked, buckets, "bucket", salt_by=["number"]).filter(F.col("bound") <= F.col("length") * F.col("longest") * (1 + _SLACK) + 1e-6)
    split = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    found = split.drop("length").groupBy("bucket", "part").cogroup(asked.drop("length", "longest").groupBy("bucket", "part")).applyInArrow(
        _bucket_search(width, k, alike), "anchor long, place long, number long, id long, score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "number")
    out = settle(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    forget(buckets)
    return out


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
         vector: str = "embedding", id_col: str = "vec_id", label: str = "label", bucket_rows: int = BUCKET_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and positive.

    Components become floor(scale * x); a score is the integer inner product with the anchor, higher ones first, equal ones by
    smaller id. ``anchors`` picks the rows that ask. An anchor's positives are its first rows of the same label; for each of them the
    first rows of other labels with ``low`` to ``high`` percent of the positive's score are returned.

    Defined results: rows whose label or vector is null, or that hold a null or non-finite component, take no part; a shorter
    vector counts as filled up with zeros, an empty one has score 0; components stop at 2^22 on both sides, so that scores of up
    to 4,096 components are exact; a row without an id is no anchor, and comes last among equal scores; repeated rows are rows of
    their own, each the other's positive; a positive with a negative score has no negatives; an empty table gives an empty
    table; other columns, texts of any length among them, are not read. ``bucket_rows`` and ``sample`` don't change the result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    usual = vectors.filter(F.col(label).isNotNull() & usable(vector))
    slim = usual.select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole_components(vector, scale).alias("vector"),
        F.coalesce(anchors & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"))
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    rows = slim.withColumns({"below": -square, "code": F.xxhash64("vector")})
    rows = number_rows(rows, ["below", "id", "label", "code"], "number").withColumn("length", F.sqrt(-F.col("below").cast("double")))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = rows.withColumn("bucket", F.floor(F.col("number") / bucket_rows).cast("long"))
    few = settle(rows.orderBy(F.xxhash64("number"), "number").limit(sample).withColumn("bucket", F.lit(0).cast("long")))
    asking = settle(rows.filter("asks").select("number", "id", "label", "vector", "length"))
    rows, few = (r.select("number", "id", "label", "vector", "length", "bucket") for r in (rows, few))

    def window(place, at_least, at_most):
        return F.struct(place.cast("long").alias("place"), at_least.cast("long").alias("low"), at_most.cast("long").alias("high"))

    least, most = F.lit(-(1 << 62)), F.lit(1 << 62)
    # the same label: any k rows bound the k-th score from below
    seen = _search(few, asking.withColumns({"bound": F.lit(float("-inf")), "windows": F.array(window(F.lit(0), least, most))}), width, positives, True)
    reached = seen.filter(F.col("rank") == positives).select(F.col("anchor").alias("number"), F.col("score").alias("reached"))
    bounded = asking.join(reached, "number", "left").withColumn("reached", F.coalesce("reached", least))
    bounded = settle(bounded.select("*", F.col("reached").cast("double").alias("bound"), F.array(window(F.lit(0), F.col("reached"), most)).alias("windows")).drop("reached"))
    best = _search(rows, bounded, width, positives, True)

    # other labels, inside the window of every positive
    best = best.select(F.col("anchor").alias("number"), F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    limits = best.filter("positive_score >= 0").withColumns({
        "low": F.expr(f"({low} * positive_score + 99) div 100"), "high": F.expr(f"({high} * positive_score) div 100")})

    def ask(limits: DataFrame) -> DataFrame:
        windows = limits.groupBy("number").agg(F.min("low").cast("double").alias("bound"), F.array_sort(F.collect_list(window(F.col("place"), F.col("low"), F.col("high")))).alias("windows"))
        return settle(asking.join(windows, "number"))

    tried = _search(few, ask(limits), width, negatives, False)
    reached = tried.filter(F.col("rank") == negatives).select(F.col("anchor").alias("number"), "place", F.col("score").alias("reached"))
    closer = limits.join(reached, ["number", "place"], "left").withColumn("low", F.greatest("low", F.coalesce("reached", "low")))
    found = _search(rows, ask(closer), width, negatives, False)
    named = best.join(asking.select("number", F.col("id").alias("anchor_id")), "number")
    found = found.select(F.col("anchor").alias("number"), "place", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(named, ["number", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
