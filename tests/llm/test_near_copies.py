"""Groups of near copies against all pairs of shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from arborlake.llm.near_copies import CLASSES, _Group, _parities, similar_groups
from conftest import documents
from test_simhash import groups as fingerprint_groups


def shingles(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(" ".join(words[k: k + size]) for k in range(max(len(words) - size + 1, 1 if words else 0)))


def brute(rows):
    """{row number: smallest id that links reach}."""
    sets, lead = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or 5 * len(sets[a] & sets[b]) >= 4 * union:
                lead[root(a)] = root(b)
    low = {}
    for k, (key, _) in enumerate(rows):
        low.setdefault(root(k), []).append(key)
    return [min((x for x in low[root(k)] if x is not None), default=None) for k in range(len(rows))]


def planted(seed=4):
    """Texts of invented words, copies of each with one to six changed words, and a large group of copies of one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for k in range(30):
        base = [word() for _ in range(rng.choice([3, 12, 60, 150, 400]))]
        texts.append(" ".join(base))
        for changes in range(1, 7) if k else [1, 2, 3] * 40:
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("crowd", [4096, 5])
def test_groups_are_those_of_all_pairs(spark, crowd):
    texts = [*planted(), None, "", " ", "One two", "one TWO"]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (None, "alone of all")]
    docs = documents(spark, [t for _, t in rows], [k for k, _ in rows])
    found = sorted(((r["doc_id"], r["component_id"]) for r in similar_groups(docs, crowd=crowd).collect()), key=str)
    assert found == sorted(((key, low) for (key, _), low in zip(rows, brute(rows))), key=str)


def test_empty(empty):
    assert similar_groups(empty).count() == 0


def test_stage_drops_copies_of_a_few_changed_words(spark):
    rows = list(enumerate(planted()))
    docs = documents(spark, [t for _, t in rows])
    after = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").select("doc_id").collect()}
    assert after == set(brute(rows))
    assert len(after) < len({component for _, _, component in fingerprint_groups(rows, 2)})


def connected(sets, similarity):
    lead = list(range(len(sets)))

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both) * (1 - 1e-12):
                lead[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(sets))]


@pytest.mark.parametrize("size,shared", [(40, 0), (300, 0), (300, 30), (64, 5), (65, 5), (2, 0)])
def test_members_of_a_key_in_bit_planes(size, shared):
    """Sets around several centres, some of them too far from it, with and without members that are connected already."""
    rng = np.random.default_rng(size + shared)
    common = rng.integers(0, 1 << 63, shared, np.uint64)
    centres = [np.concatenate([common, rng.integers(0, 1 << 63, n, np.uint64)]) for n in (5, 40, 40, 200, 1500)]
    sets = []
    for _ in range(size):
        s = centres[rng.integers(len(centres))].copy()
        change = rng.random(len(s)) < rng.choice([0.0, 0.02, 0.06, 0.1, 0.3])
        s[change] = rng.integers(0, 1 << 63, change.sum(), np.uint64)
        sets.append(np.unique(s))
    sets.sort(key=len)
    odd = _parities(sets).reshape(size, CLASSES // 64)
    group = _Group(np.arange(size), np.array([len(s) for s in sets]), odd, sets, np.arange(size), 0.8)
    if size > 64:
        group.many(0, size)
    else:
        group.few(np.array([0]), np.array([size]))
    want = connected(sets, 0.8)
    assert len(group.links) == size - len(set(want))
    assert [group._find(k) for k in range(size)] == want


def test_a_thousand_pairs_from_the_threshold_upwards(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, linked = [], 0
    while linked < 1000:
        base = [word() for _ in range(rng.choice([15, 30, 60, 150, 300]))]
        copy = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 40))):
            copy[rng.randrange(len(copy))] = word()
        pair = [" ".join(base), " ".join(copy)]
        a, b = map(shingles, pair)
        if len(a & b) >= 0.7 * len(a | b):
            linked += 5 * len(a & b) >= 4 * len(a | b)
            rows += [(len(rows) + k, t, 5 * len(a & b) >= 4 * len(a | b)) for k, t in enumerate(pair)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in similar_groups(docs).collect()}
    assert all((found[k] == k - k % 2) == (near or k % 2 == 0) for k, _, near in rows)


@pytest.mark.parametrize("crowd", [4096, 30])
def test_unlike_texts_with_a_common_line(spark, crowd):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    line = " ".join(word() for _ in range(14))
    texts = [f"{line} {' '.join(word() for _ in range(5))}" for _ in range(400)] + ["long " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in similar_groups(docs, crowd=crowd).collect()}
    assert found == {k: k for k in range(len(texts))}


def test_stage_takes_links_of_fingerprints_and_of_sets(spark):
    """Groups of either kind count: texts of one fingerprint whose sets differ, and similar sets of other fingerprints."""
    from arborlake.llm.simhash import near_groups

    words = [f"w{k}" for k in range(60)]
    turned = words.copy()
    turned[30] = "other"
    docs = [(1, "same words " * 40), (2, "same words " * 80), (3, " ".join(words)), (4, " ".join(turned)), (5, "A B c"), (6, "a b C"), (7, "quite another text")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    prints = {r["doc_id"]: r["component_id"] for r in near_groups(frame).collect()}
    sets = {r["doc_id"]: r["component_id"] for r in similar_groups(frame).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()}
    assert kept == {k for k in prints if prints[k] == k and sets[k] == k}
    halves = [spark.createDataFrame(rows, "doc_id long, component_id long") for rows in (
        [(1, 1), (2, 1), (3, 3), (4, 4), (None, None)], [(1, 1), (2, 2), (3, 2), (4, 4), (None, 4)])]
    joined = sorted(((r["doc_id"], r["component_id"]) for r in corpus_pipeline.joined_groups(*halves).collect()), key=str)
    assert joined == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (None, None), (None, 4)], key=str)


def test_stage_goes_through_the_operator(spark, monkeypatch):
    """A pair that fingerprints alone link leaves one document."""
    docs = spark.createDataFrame([(1, "one text"), (2, "a different one")], "doc_id long, text string")
    pair = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, component_id long")
    monkeypatch.setattr(corpus_pipeline, "near_groups", lambda rows: pair)
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()] == [1]
