import collections
import re

import pytest
from pyspark.sql import functions as F

from arborlake.llm.curriculum import SCHEDULES, curriculum, integrals, time_of, training_rows, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_of(sizes, weights, repeats):
    """Share by weight, stop at the caps, share the excess again until nothing is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = {s: repeats * sizes[s] for s in free if level * weight[s] >= repeats * sizes[s]}
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= over


def check(rows, out, repeats=3, schedules=SCHEDULES):
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets_of(sizes, [integrals(k)[-1] for k in schedules], repeats)
    uses = [r for r in out if r["words"]]
    assert sorted(r["step"] for r in uses) == list(range(len(uses)))
    each = collections.defaultdict(list)
    for r in out:
        each[r["doc_id"], r["code"], r["source"], r["again"]].append(r)
    assert len(each) == len(rows)
    assert collections.Counter((k[0], k[2], v[0]["size"]) for k, v in each.items()) == collections.Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in rows)
    taken = collections.Counter()
    for (_, _, s, _), found in each.items():
        assert found[0]["target"] == pytest.approx(want[s]) and found[0]["source_size"] == sizes[s]
        assert sum(r["words"] for r in found) <= repeats * found[0]["size"]
        assert len({r["turn"] for r in found}) == len(found)
        taken[s] += sum(r["words"] for r in found)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert want[s] - 1.0001 <= taken[s] <= want[s] + 1e-6


@pytest.mark.parametrize("cell_rows", [20_000, 5])
def test_edge_rows(docs, cell_rows):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    check(rows, curriculum(docs, cell_rows=cell_rows).collect())


def test_no_broadcast(docs, no_broadcast):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    check(rows, curriculum(docs, cell_rows=9).collect())


def test_small_sources_are_repeated_and_hot_ones_cut(spark):
    rows = [(k, "w " * (1 + k % 7), "hot" if k % 3 else f"s{k % 30:02}") for k in range(1200)] + [(9000 + k, "a b c", None) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = curriculum(docs).collect()
    check(rows, out)
    assert {r["turn"] for r in out if r["source"] is None and r["words"]} == {0, 1, 2}
    check(rows, curriculum(docs, repeats=1).collect(), repeats=1)


def test_mixture_follows_the_schedule(spark):
    schedules = (((0.0, 1.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 1.0)))
    rows = [(k, "w", "ab"[k % 2]) for k in range(4000)]
    out = curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"), schedules=schedules).filter("words > 0").orderBy("step").collect()
    for part in range(10):
        seen = out[part * 400: part * 400 + 400]
        assert sum(r["source"] == "a" for r in seen) / 400 == pytest.approx(1 - (part + 0.5) / 10, abs=0.01)
    assert [r["time"] for r in out] == sorted(r["time"] for r in out)


@pytest.mark.parametrize("knots", [*SCHEDULES, ((0.0, 0.0), (0.25, 0.0), (0.5, 2.0), (1.0, 0.0)), ((0.0, 3.0), (1.0, 3.0))])
def test_inverse(spark, knots):
    shares = [k / 40 for k in range(41)]
    found = spark.createDataFrame([(s,) for s in shares], "s double").select("s", time_of(F.col("s"), knots).alias("t")).collect()
    for s, t in found:
        done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            end = min(max(t, t0), t1)
            done += (end - t0) * (w0 + w0 + (w1 - w0) / (t1 - t0) * (end - t0)) / 2
        assert done / integrals(knots)[-1] == pytest.approx(s, abs=1e-9)
    assert [t for _, t in found] == sorted(t for _, t in found)


def test_many_repeated_rows(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"))
    out = curriculum(docs, cell_rows=1000)
    assert out.count() == 20_000 and out.agg(F.sum("words")).first()[0] == 40_000 and out.select("again").distinct().count() == 20_000


def test_texts_in_order_and_reruns(docs, empty):
    mix = curriculum(docs)
    again = curriculum(docs.repartition(7))
    columns = ["doc_id", "code", "again", "source", "turn", "words", "time", "step"]
    assert sorted(map(str, mix.select(columns).collect())) == sorted(map(str, again.select(columns).collect()))
    texts = {(r["doc_id"], r["code"]): r["text"] for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("code")).collect()}
    found = {r["step"]: r["text"] for r in training_rows(docs, mix).collect()}
    uses = [r for r in mix.collect() if r["words"]]
    assert sorted(found) == sorted(r["step"] for r in uses)
    for r in uses:
        whole = texts[r["doc_id"], r["code"]]
        assert whole.startswith(found[r["step"]]) and len(WORD.findall(found[r["step"]])) == r["words"]
    assert curriculum(empty).count() == 0
    assert {r["step"] for r in curriculum(docs, seed=5).filter("words > 0 AND doc_id = 7").collect()} != {r["step"] for r in uses if r["doc_id"] == 7}


def test_word_count(spark, docs):
    for text, n in docs.select("text", word_count(F.col("text")).alias("n")).collect():
        assert n == len(WORD.findall(text or ""))


@pytest.mark.parametrize("knots", [((0.0, 1.0),), ((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 0.0))])
def test_bad_schedules(docs, knots):
    with pytest.raises(ValueError):
        curriculum(docs, schedules=(knots,))
