import collections
import hashlib
import re

import numpy as np

from arborlake.llm.substring_dedup import BASES, dedup_substrings, rolling


def brute(rows, window):
    """(id, text) -> words, what stays, and the intervals that go."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        spans, k = [], 0
        while k < len(w):
            if gone[k]:
                end = next((j for j in range(k, len(w)) if not gone[j]), len(w))
                spans.append((k, end))
                k = end
            else:
                k += 1
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), tuple(spans)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"], tuple(map(tuple, r["removed_spans"]))) for r in df.collect()), key=repr)


def test_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for window, part in ((35, 1 << 20), (5, 2000), (1, 5000)):
        assert found(dedup_substrings(docs, window=window, part_bytes=part)) == brute(rows, window)


def test_columns(docs, empty):
    done = dedup_substrings(docs)
    assert done.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "kept_text", "removed_spans"]
    assert done.select("doc_id", "part", "row", "code").exceptAll(docs.select("doc_id", "part", "row", "code")).count() == 0
    assert dedup_substrings(empty).count() == 0
    assert dedup_substrings(docs.filter("text IS NULL")).select("n_words", "kept_text").distinct().collect() == [(0, "")]


def test_text_is_shuffled_once(docs):
    plan = dedup_substrings(docs.select("doc_id", "text")).select("doc_id", "kept_text")
    plan.count()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FlatMapGroupsInArrow") >= 2 and "FlatMapCoGroupsInArrow" in text


def test_rolling_hash_depends_on_words_and_order_alone():
    codes = np.array([5, 6, 7, 5, 6, 7, 7, 6, 5], np.uint64)
    h = rolling(codes, 3, BASES[0])
    assert h[0] == h[3] and len(set(h.tolist())) == 6
    assert len(rolling(codes[:2], 3, BASES[0])) == 0


def test_digest_of_the_query(spark, docs):
    from pyspark.sql import functions as F

    row = dedup_substrings(docs.filter("doc_id = 7")).select("kept_text", F.sha2("kept_text", 256).alias("d")).first()
    assert row["d"] == hashlib.sha256(row["kept_text"].encode()).hexdigest()


def test_a_part_takes_little_memory():
    """What a worker holds for one part of ordinary size, beside the text: before, 130 MB for 4.1 MB of text."""
    import random
    import tracemalloc

    import pyarrow as pa

    from arborlake.llm.substring_dedup import _fingerprint, _remove

    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(1000)) for _ in range(750)]
    rows = pa.table({"part": pa.array([0] * len(texts), pa.int32()), "row": pa.array([{"doc_id": k, "text": t} for k, t in enumerate(texts)])})
    none = pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "again": pa.array([], pa.binary())})
    size = sum(map(len, texts))
    for run in (lambda: _fingerprint(35, 128, "text")(rows), lambda: _remove(35, 128, "text")(rows, none)):
        tracemalloc.start()
        run()
        assert tracemalloc.get_traced_memory()[1] < 17 * size
        tracemalloc.stop()
