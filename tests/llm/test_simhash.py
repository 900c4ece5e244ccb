import random
import re

import numpy as np
import pytest
import xxhash

from arborlake.llm.simhash import close_pairs, keep_one, links, near_groups


def fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, radius, shingle=3):
    prints = [fingerprint(t, shingle) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, format(p, "016x"), least.get(find(i))) for i, ((key, _), p) in enumerate(zip(rows, prints))), key=repr)


@pytest.mark.parametrize("radius,members", [(2, 4096), (2, 1), (3, 4096)])
def test_against_brute_force(docs, radius, members):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in near_groups(docs, radius=radius, members=members).collect()), key=repr)
    assert found == groups(rows, radius)


def test_bit_planes_against_all_pairs():
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(60)] + [rng.getrandbits(64) for _ in range(80)]
    keys = sorted(rng.choice([1, 1, 1, 2, 3, 4, 5]) for _ in fps)
    fps = np.array(fps, np.uint64)
    for radius in (1, 2, 3, 5):
        i, j = close_pairs(np.array(keys, np.int64), fps, radius)
        found = set(zip(i.tolist(), j.tolist()))
        assert len(found) == len(i)
        assert found == {(a, b) for b in range(len(fps)) for a in range(b) if keys[a] == keys[b] and int(fps[a] ^ fps[b]).bit_count() <= radius}


@pytest.mark.parametrize("members", [1, 3, 4096])
def test_links_lose_nothing(spark, members):
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        c = rng.getrandbits(64)
        fps |= {c} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {frozenset(r) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, members).collect()}
    unsigned = {f: f & (1 << 64) - 1 for f in signed}
    assert found == {frozenset((a, b)) for a in signed for b in signed if a < b and (unsigned[a] ^ unsigned[b]).bit_count() <= 2}


def test_one_of_each_group_stays(docs, texts):
    found = near_groups(docs)
    kept = keep_one(docs, found)
    want = {r["component_id"] for r in found.collect() if r["component_id"] is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted(want)


def test_empty(empty):
    assert near_groups(empty).count() == 0
    assert keep_one(empty, near_groups(empty)).count() == 0
