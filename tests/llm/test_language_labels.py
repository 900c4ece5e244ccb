"""Labels with few rows, and more labels than 64, are classes like any other."""

import random

from pyspark.sql import functions as F

from arborlake.llm.language_id import fit, language_id
from test_language_id import speak

#: Letters of scripts and the first of 26 letters each.
SCRIPTS = {"ru": 0x0430, "el": 0x03B1, "hy": 0x0561, "ka": 0x10D0}


def write(rng, first, n=60):
    return " ".join("".join(chr(first + rng.randrange(24)) for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_documents_of_rare_labels_stay(spark):
    rng = random.Random(3)
    rare = [(k, write(rng, SCRIPTS[lang]), lang) for k, lang in enumerate(list(SCRIPTS) * 5)]
    common = spark.createDataFrame([(100 + k, speak(rng, lang, 40), lang) for k, lang in enumerate(["en", "fr", "de"] * 20)], "doc_id long, text string, lang string")
    common = common.crossJoin(spark.range(500)).select((F.col("id") * 1000 + F.col("doc_id")).alias("doc_id"), F.concat_ws(" ", "text", F.col("id").cast("string")).alias("text"), "lang")
    docs = common.unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    model = fit(docs)
    assert set(model) == {"en", "fr", "de", *SCRIPTS}
    found = {r["id"]: r for r in language_id(docs.filter("doc_id < 100 OR doc_id % 1000 = 100"), model, declared="lang").collect()}
    assert [(found[k]["lang"], found[k]["rejected"]) for k, _, _ in rare] == [(lang, False) for _, _, lang in rare]
    # what is in none of the labels still goes
    assert language_id(spark.createDataFrame([(1, write(rng, 0x4E00, 200))], "doc_id long, text string"), model).first()["rejected"]


def test_more_than_64_labels(spark):
    rng = random.Random(5)
    rows = [(k, write(rng, 0x4E00 + 30 * (k % 70)), f"l{k % 70:02}") for k in range(280)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    assert len(model) == 70
    found = {r["id"]: r for r in language_id(docs, model, declared="lang").collect()}
    assert all(found[k]["lang"] == lang and not found[k]["rejected"] for k, _, lang in rows)


def test_sample_is_bounded_for_every_label(spark):
    from arborlake.llm import language_id as module

    rows = spark.range(3000).select(
        F.when(F.col("id") < 5, "few").when(F.col("id") < 2000, "same").otherwise("many").alias("lang"),
        F.when((F.col("id") >= 5) & (F.col("id") < 2000), F.col("id") % 30).otherwise(F.col("id")).alias("key"))
    rows = rows.select("lang", F.xxhash64("lang", "key").alias("mark"), F.col("key").cast("string").alias("text"))
    got = {}
    for r in module._sample(rows, 20).collect():
        got.setdefault(r["lang"], set()).add(r["text"])
    want = {}
    for r in rows.distinct().orderBy("mark").collect():
        if len(want.setdefault(r["lang"], set())) < 20:
            want[r["lang"]].add(r["text"])
    assert got == want and {k: len(v) for k, v in got.items()} == {"few": 5, "same": 20, "many": 20}
