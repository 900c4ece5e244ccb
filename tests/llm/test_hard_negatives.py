import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm.hard_negatives import LARGEST, Bucket, mine

NAN, INF = float("nan"), float("inf")


def brute(rows, asks, positives=5, negatives=10, low=30, high=90):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [max(min(math.floor(256 * x), LARGEST), -LARGEST) for x in v], label))
    last, out = 1 << 63, []
    for a, (i, v, label) in enumerate(kept):
        if i is None or not asks(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), last if j is None else j, l, j) for b, (j, w, l) in enumerate(kept) if b != a)
        for s, _, _, j in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, x[3], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(map(str, out))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, 2, 3) for i, v, l in rows], "vec_id long, embedding array<float>, label int, bucket string, number int, length int, part int").repartition(3)


def some_rows(seed, n, dims=8, labels=4, spread=0.5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels * 3)]
    rows = []
    for i in range(n):
        c, size = rng.choice(centres), rng.choice([0.3, 1, 1, 2.5])
        rows.append((i, [float(np.float32(size * (x + rng.gauss(0, spread)))) for x in c], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("bucket_rows,sample", [(16_384, 4_096), (16, 20), (7, 1)])
def test_against_all_pairs(spark, bucket_rows, sample):
    rows = some_rows(1, 150) + [(900 + k, rows_v, k % 4) for k, rows_v in enumerate([[0.5] * 8] * 20)]
    out = mine(frame(spark, rows), F.col("vec_id") % 10 == 0, bucket_rows=bucket_rows, sample=sample)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted(map(str, map(tuple, out.collect()))) == want and len(want) > 300


def test_edge_rows(spark):
    ones = [1.0] * 4
    rows = [
        (0, ones, 1), (10, None, 1), (20, ones, None), (30, [1.0, None, 1.0, 1.0], 1), (40, [NAN] * 4, 1), (50, [INF, 0.0, 0.0, 0.0], 1), (60, [], 2), (70, [0.0] * 4, 1),
        (None, ones, 1), (None, [0.5] * 4, 2), (3, [1.0, 1.0], 1), (80, [1e30, -1e30, 1.0, 0.0], 2), (4, [0.4] * 4, 2), (5, [-1.0] * 4, 2), (90, [-1.0] * 4, 1), (6, [0.31] * 4, 3), (7, ones, 1)]
    out = mine(frame(spark, rows), F.col("vec_id") % 10 == 0, bucket_rows=5)
    assert sorted(map(str, map(tuple, out.collect()))) == brute(rows, lambda i: i % 10 == 0)


def test_repeated_anchors(spark):
    rows = [(0, [1.0, 0.0], 1)] * 3 + [(k, [0.9 - k / 50, 0.1], 2) for k in range(1, 15)]
    out = mine(frame(spark, rows), F.col("vec_id") == 0)
    assert sorted(map(str, map(tuple, out.collect()))) == brute(rows, lambda i: i == 0)


def test_no_broadcast(spark, no_broadcast):
    rows = some_rows(5, 60)
    out = mine(frame(spark, rows), F.col("vec_id") % 10 == 0, bucket_rows=16, sample=12)
    assert sorted(map(str, map(tuple, out.collect()))) == brute(rows, lambda i: i % 10 == 0)


def test_empty(spark):
    assert mine(frame(spark, some_rows(2, 5)).limit(0), F.col("vec_id") >= 0).count() == 0
    assert mine(frame(spark, some_rows(2, 5)), F.col("vec_id") > 100).count() == 0


def test_pruning_keeps_all_answers():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    vectors = np.floor(64 * (centres[rng.integers(0, 20, 4000)] + 0.2 * rng.normal(size=(4000, 16))))
    vectors = vectors[np.argsort((vectors * vectors).sum(axis=1))]
    buckets, cut, asked = [Bucket(vectors[k: k + 500]) for k in range(0, 4000, 500)], 0, 0
    for anchor in vectors[::70]:
        scores = (vectors @ anchor).astype(np.int64)
        for k in (5, 50):
            bound = np.sort(scores)[-k]
            for n, bucket in enumerate(buckets):
                mine = scores[n * 500: n * 500 + 500]
                places = bucket.candidates(anchor, float(bound))
                places = np.arange(500) if places is None else places
                assert set(np.flatnonzero(mine >= bound)) <= set(places)
                assert (bucket.scores(anchor, places) == mine[places]).all()
                cut, asked = cut + 500 - len(places), asked + 500
            assert len(bucket.candidates(anchor, 1e12)) == 0
    assert cut > 0.6 * asked  # clustered vectors: most rows are never multiplied
