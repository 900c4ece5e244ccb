import collections
import random
import re
import zlib

import numpy as np
import pytest

from arborlake.llm.fm_index import BidirectionalIndex, _suffix_order
from arborlake.llm.spelling import near_words, roots, spelling_groups, vocabulary


def edits(word, alphabet):
    for k in range(len(word) + 1):
        for c in alphabet:
            yield word[:k] + c + word[k:]
            if k < len(word) and c != word[k]:
                yield word[:k] + c + word[k + 1:]
        if k < len(word):
            yield word[:k] + word[k + 1:]


def neighbours(words):
    """By making all edits: near words of each word."""
    alphabet = sorted({c for w in words for c in w})
    return {w: {e for e in edits(w, alphabet) if e in words} - {w} for w in words}


def brute(rows, least=7, seldom=2, times=10):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= least
    words = {w: n for w, n in count.items() if n >= seldom}
    near = neighbours(words)
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= times * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def some_words(seed, n, letters, low, high):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        words.add("".join(rng.choice(letters) for _ in range(rng.randint(low, high))))
        if words and rng.random() < 0.6:
            w = list(rng.choice(sorted(words)[:50]))
            w[rng.randrange(len(w))] = rng.choice(["", rng.choice(letters), rng.choice(letters) * 2])
            words.add("".join(w) or letters[0])
    return sorted(words - {""})


@pytest.mark.parametrize("text", [[1, 2, 1, 2, 3, 1, 0], [1, 0], [0], [1] + [2, 1] * 40 + [0], [2] * 100 + [0]])
def test_suffix_order(text):
    found = _suffix_order(np.array(text), 2).tolist()
    assert found == sorted(range(len(text)), key=lambda k: text[k:])


@pytest.mark.parametrize("seed,n,letters,low,high", [(1, 300, "ab", 1, 9), (2, 400, "abcé", 1, 12), (3, 200, "a", 1, 200), (4, 300, "abcdefghijklmnopqrstuvwxyzàéîõü", 7, 9), (5, 1, "z", 3, 3)])
def test_index_finds_all_single_errors(seed, n, letters, low, high):
    words = some_words(seed, n, letters, low, high) if len(letters) > 1 or n == 1 else ["a" * k for k in range(1, n)]
    index = BidirectionalIndex(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words]))
    a, b = index.near(np.arange(len(words)))
    want = neighbours(set(words))
    found = collections.defaultdict(set)
    for i, j in zip(a.tolist(), b.tolist()):
        assert words[j] not in found[words[i]]
        found[words[i]].add(words[j])
    assert {w: found[w] for w in words} == want


@pytest.mark.parametrize("members,points", [(20_000, 400_000), (25, 300), (3, 60)])
def test_near_words_with_crowded_halves(spark, members, points):
    words = some_words(6, 700, "abc", 1, 11) + ["prefix" + w for w in some_words(7, 300, "xyz", 3, 5)] + [w + "suffix" for w in some_words(8, 60, "qr", 4, 6)]
    words = sorted(set(words))
    out = near_words(spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long"), members, points).collect()
    found = collections.defaultdict(set)
    for r in out:
        assert r["other"] not in found[r["word"]] and words[r["other_n"]] == r["other"]
        found[r["word"]].add(r["other"])
    assert {w: found[w] for w in words} == neighbours(set(words))


def test_edge_rows(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for least in (7, 2):
        out = spelling_groups(docs, least=least)
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, brute(rows, least)))


def test_planted_slips(spark):
    rng = random.Random(9)
    base = ["straightforward", "équilibristes", "wonderfully", "WONDERFULLY", "neighbourhood", "neighborhood", "×paragraphs÷", "sharing", "sharings"]
    rows = [(k, " ".join(rng.choice(base[:1] * 30 + base) for _ in range(60)) + "-7letters") for k in range(400)] + [(None, "lonely1 wonderfuly wonderfuly"), (5, None), (6, ""), (6, "a" * 3000), (6, "a" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    found = spelling_groups(docs, members=10, block_points=200).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert sum(r["form"] is not None for r in found) > 20


def test_chains_lead_to_the_last(spark):
    words = {"a" * k: 10 ** k for k in range(1, 12)}
    forms = spark.createDataFrame([(w, w + "a") for w in words], "word string, form string")
    assert {r["word"]: r["root"] for r in roots(forms).collect()} == {w: "a" * 12 for w in words}


def test_empty_and_bad(empty, docs):
    assert spelling_groups(empty).count() == 0
    assert vocabulary(docs, least=2, seldom=1, spoil=0).filter("length(word) < 2").count() == 0
    with pytest.raises(ValueError):
        spelling_groups(docs, times=1)
