import hashlib
import re

import pytest

from arborlake.llm import queries
from arborlake.llm.decontaminate import decontaminate


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window):
    spans = {}
    for key, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            spans.setdefault(tuple(w[i:i + window]), set()).add(key)
    lengths = {len(s) for s in spans}
    out = []
    for key, text in docs:
        w = words(text)
        hit, named = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in spans:
                    hit |= set(range(i, i + n))
                    named |= spans[tuple(w[i:i + n])]
        out.append((key, len(w), len(hit), tuple(sorted(str(k) for k in named if k is not None)), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark, texts):
    long = [t for t in texts if t and len(words(t)) > 40]
    rows = [
        (1, " ".join(words(long[0])[5:25])), (10, " ".join(words(long[1])[:10]).upper()), (9, " ".join(words(long[1])[3:16])), (9, " ".join(words(long[1])[3:16])),
        (4, "naïve"), (5, "of, AND!! in"), (6, None), (7, "  ...  "), (8, "words that no document has in this very order at all 77"), (None, " ".join(words(long[2])[8:20])),
    ]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("window,gram", [(10, 5), (10, 10), (6, 2), (4, 5)])
def test_against_brute_force(docs, items, window, gram):
    mine = [(r["doc_id"], r["text"]) for r in docs.collect()]
    theirs = [(r["item_id"], r["text"]) for r in items.collect()]
    done = decontaminate(docs, items, window=window, gram=gram).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in done), key=repr) == brute(mine, theirs, window)
    assert any(r["contaminated"] for r in done) and not all(r["contaminated"] for r in done)


def test_shuffled_join_gives_the_same(docs, items, no_broadcast, monkeypatch):
    from arborlake.llm import decontaminate as module

    monkeypatch.setattr(module, "fits_broadcast", lambda *a, **k: False)
    mine = [(r["doc_id"], r["text"]) for r in docs.collect()]
    theirs = [(r["item_id"], r["text"]) for r in items.collect()]
    done = module.decontaminate(docs, items).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in done), key=repr) == brute(mine, theirs, 10)


def test_empty_tables(docs, items, empty):
    assert decontaminate(empty, items).count() == 0
    none = decontaminate(docs, items.limit(0))
    assert none.count() == docs.count() and none.filter("contaminated OR n_hit > 0 OR size(items) > 0").count() == 0


def test_no_python_in_the_plan(docs, items):
    plan = decontaminate(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_and_sql(spark):
    import oracle

    sf = "/root/testdata/sf0.001"
    for name in queries.SQL:
        assert oracle.compare(spark, oracle.connect(sf), sf, queries.QUERIES[name], queries.SQL[name]) == "", name


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
