import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from arborlake.llm.language_id import BINS, FLOOR, STRENGTH, UNKNOWN, UNKNOWN_PRIOR, fit, language_id

SYLLABLES = {"en": "the ing tion and er was th sh".split(), "fr": "eau oux ère que les ment è çoi".split(), "de": "sch ung ich keit über zu ß ein".split()}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(k, speak(rng, lang, rng.randint(5, 80)), lang) for k, lang in enumerate(["en", "fr", "de", "en"] * 150)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


@pytest.fixture(scope="module")
def model(labelled):
    return fit(labelled)


def test_held_out_accuracy(spark, labelled):
    model = fit(labelled.filter("doc_id % 8 < 4"))
    held = labelled.filter("doc_id % 8 >= 4").withColumn("truth", F.col("lang"))
    found = {r["id"]: r["lang"] for r in language_id(held, model).collect()}
    truth = {r["doc_id"]: r["truth"] for r in held.collect()}
    assert sum(found[k] == truth[k] for k in truth) >= 0.99 * len(truth)


def test_bounded_sample(labelled):
    few = fit(labelled, sample=50, languages=2)
    assert len(few) == 2
    assert set(fit(labelled)) == {"en", "fr", "de"}


def test_declaration_and_host_decide_where_the_text_does_not(spark, model):
    rng = random.Random(7)
    rows = [(k, speak(rng, "fr", 30), "fr", "www.journal.fr") for k in range(200)] + [(200 + k, speak(rng, "de", 30), "de", "www.zeitung.de") for k in range(200)]
    rows += [(1000, "qxz", "fr", None), (1001, "qxz", "de", None), (1002, "qxz", None, "www.journal.fr"), (1003, "qxz", None, "other.zeitung.de"), (1004, "qxz", None, "new.example.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, said string, site string")
    found = {r["id"]: r for r in language_id(docs, model, host=F.col("site"), declared="said").collect()}
    assert [found[k]["lang"] for k in range(1000, 1005)] == ["fr", "de", "fr", "de", "de"]
    assert found[1002]["probability"] > found[1004]["probability"] > 0.4


def test_text_overrules_a_false_declaration(spark, model):
    rng = random.Random(8)
    rows = [(k, speak(rng, "en", 40), "en") for k in range(50)] + [(99, speak(rng, "fr", 40), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, said string")
    assert {r["id"]: r["lang"] for r in language_id(docs, model, declared="said").collect()}[99] == "fr"


def test_markup(spark, model):
    rng = random.Random(9)
    body = speak(rng, "de", 30)
    rows = [(1, f"<html lang='de-AT'><script>var the = 'the the ing';</script><!-- the the --><p>{body}</p>"), (2, "<p>the ing tion &amp; was and the other</p>"),
            (3, "<script>the the"), (4, "<html lang=fr><style>a{}</style>"), (5, None), (6, "<HTML class=x LANG=\"EN\">qxz")]
    docs = spark.createDataFrame(rows, "page_id long, html string")
    found = {r["id"]: r for r in language_id(docs, model, text="html", id_col="page_id", markup=True).collect()}
    assert (found[1]["lang"], found[1]["declared"]) == ("de", "de") and found[2]["lang"] == "en"
    assert found[6]["declared"] == "en"
    assert all(found[k]["rejected"] and found[k]["grams"] == 0 for k in (3, 4, 5))


def test_rejection(spark, model):
    rng = random.Random(10)
    noise = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400))
    rows = [(1, noise), (2, "12345 --- 67890 !!!"), (3, speak(rng, "en", 3)), (4, ""), (5, None), (6, speak(rng, "fr", 20_000)), (6, "the"), (None, "the and was")]
    docs = spark.createDataFrame([(*r, "h", "r", 1) for r in rows], "doc_id long, text string, host string, row string, code int")
    found = [(r["id"], r["lang"], r["rejected"]) for r in language_id(docs, model).collect()]
    assert {(k, r) for k, _, r in found} == {(1, True), (2, True), (3, False), (4, True), (5, True), (6, False), (None, False)}
    assert (1, UNKNOWN, True) in found and len(found) == len(rows)


def test_no_labels_reject_nothing(docs, empty):
    none = fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none == {}
    assert language_id(docs, none).filter("rejected").count() == 0
    assert language_id(empty, fit(docs)).count() == 0


def test_edge_rows(docs):
    out = language_id(docs, fit(docs), host=F.col("source"), declared="lang")
    assert out.count() == docs.count()
    blank = {r["doc_id"] for r in docs.collect() if not re.search(r"[^\W\d_]|[^\x00-\x7f]", r["text"] or "")}
    assert {r["id"] for r in out.filter("rejected AND id IS NOT NULL").collect()} == blank - {None}


def plain_bins(text):
    data = (text or "").encode() + b" "
    data = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in data]
    three = [data[k: k + 3] for k in range(len(data) - 2)]
    return [((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 16 for a, b, c in three if (a, b, c) != (32, 32, 32)]


def plain_softmax(logs):
    exps = [math.exp(v - max(logs)) for v in logs]
    return [e / sum(exps) for e in exps]


def plain_posteriors(rows, labelled):
    """The fused posterior of (id, text, said, site) rows by loops over every trigram, row and class."""
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter(lang for _, lang in labelled)
    for text, lang in labelled:
        counts[lang].update(plain_bins(text))
    names = sorted(docs, key=lambda k: (-docs[k], k))
    logs = {}
    for name in names:
        total = sum(counts[name].values())
        logs[name] = lambda b, c=counts[name], total=total: math.log((1 - FLOOR) * (c[b] + 0.05) / (total + 0.05 * BINS) + FLOOR / BINS)
    flat = [(1 - UNKNOWN_PRIOR) / len(names)] * len(names) + [UNKNOWN_PRIOR]
    likely, votes = [], []
    for _, text, _, _ in rows:
        bins = plain_bins(text)
        likely.append([sum(logs[n](b) for b in bins) / 3 for n in names] + [len(bins) * math.log(1 / BINS) / 3])
        votes.append([v * bool(bins) for v in plain_softmax([x + math.log(p) for x, p in zip(likely[-1], flat)])])
    wide = range(len(flat))
    whole = [sum(v[k] for v in votes) for k in wide]

    def keys(row):
        parts = (row[3] or "").lower().split(".")
        return {"host": (row[3] or "").lower(), "domain": ".".join(parts[-2:]) if len(parts) > 1 else "", "suffix": parts[-1] if len(parts) > 1 else "", "said": row[2] or ""}

    out = []
    for r, row in enumerate(rows):
        others = {name: [sum(v[k] for q, v in enumerate(votes) if q != r and key and keys(rows[q])[name] == key) for k in wide] for name, key in keys(row).items()}
        prior = [(whole[k] + STRENGTH * flat[k]) / (sum(whole) + STRENGTH) for k in wide]
        for level in ("suffix", "domain", "host"):
            n = sum(others[level])
            prior = [(others[level][k] + STRENGTH * prior[k]) / (n + STRENGTH) for k in wide]
        trust = [math.log((others["said"][k] + 1) / (whole[k] + STRENGTH)) if row[2] else 0.0 for k in wide]
        chance = plain_softmax([likely[r][k] + math.log(prior[k]) + trust[k] for k in wide])
        best = max(wide, key=lambda k: (chance[k], -k))
        out.append((row[0], [*names, UNKNOWN][best], chance[best], best == wide[-1] or not plain_bins(row[1])))
    return out


def test_posteriors_by_plain_loops(spark, labelled):
    rng = random.Random(21)
    sites = ["www.journal.fr", "blog.journal.fr", "www.zeitung.de", "zeitung.de", "a.b.example.com", "plain", None]
    rows = []
    for k in range(90):
        lang = rng.choice(["en", "fr", "de"])
        text = rng.choice([speak(rng, lang, rng.choice([1, 2, 5, 20])), "qxz", "th", "", None, "12 34", "É" * 3])
        rows.append((k, text, rng.choice([lang, lang, "en", None, "pt"]), rng.choice(sites)))
    rows += [(200, speak(rng, "de", 3000), "de", sites[2])] + [(201, "the and", "en", sites[4])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, said string, site string").repartition(3)
    few = labelled.filter("doc_id < 60")
    found = language_id(docs, fit(few), host=F.col("site"), declared="said").collect()
    want = plain_posteriors(rows, [(r["text"], r["lang"]) for r in few.collect()])
    found, want = (sorted(x, key=lambda r: (r[0], r[1])) for x in ([(r["id"], r["lang"], r["probability"], r["rejected"]) for r in found], want))
    assert [(a, b, d) for a, b, _, d in found] == [(a, b, d) for a, b, _, d in want]
    assert [p for _, _, p, _ in found] == pytest.approx([p for _, _, p, _ in want], rel=2e-3)


def test_memory_of_a_task_is_bounded_by_a_slice():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from arborlake.llm import language_id as L

    names = ["en", "fr", "de", "es"]
    flat = {name: np.full(BINS, np.log(1 / BINS)) for name in names}
    texts = pa.array(["the cat sat on the mat " * 40] * 4_000)  # 3.7 MB
    ids = pa.array(np.arange(len(texts)))
    row = pa.StructArray.from_arrays([ids, texts, pa.nulls(len(texts), pa.string())], ["doc_id", "text", "lang"])
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.nulls(len(texts), pa.string()), row], ["id", "code", "host", "row"])
    run = L._score(flat, "text", "lang", False)
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == len(texts) and most < 40, most
