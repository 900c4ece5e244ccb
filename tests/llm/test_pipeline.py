"""Every stage of the pipeline against brute force on its own input."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborlake.session import settle
from conftest import documents, make_texts
from test_decontaminate import brute as benchmark_hits
from test_near_copies import brute as components
from test_packing import expected
from test_substring_dedup import brute as substrings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents of the smallest tables and the edge rows of the other tests, before and after every stage."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    edge = documents(spark, make_texts(5)).select(F.col("doc_id") + 10_000, "text", F.coalesce("lang", F.lit("en")), "source", F.col("n_chars").cast("long")).toDF(*given.columns)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).select(
        F.col("item_id") + 20_000, F.concat(F.lit("Words before it. "), F.upper("text"), F.lit(" and after")), F.lit("en"), F.lit("web"), F.lit(1).cast("long")).toDF(*given.columns)
    docs = settle(given.unionByName(edge).unionByName(leak))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_id_rejects_texts_without_language_alone(stages):
    before, after = dict(rows(stages[0])), dict(rows(stages[1]))
    gone = set(before) - set(after)
    assert all(before[k] == after[k] for k in after)
    assert gone and all(k >= 10_000 and not (before[k] or "").strip(" \n\t ") for k in gone)


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), dict(rows(stages[2]))
    assert set(after) == set(components(before)) and len(after) < len(before)
    assert all(dict(before)[k] == after[k] for k in after)


def test_repeated_passages_go(stages):
    before, after = rows(stages[2]), {r["doc_id"]: r for r in stages[3].collect()}
    assert len(before) == len(after)
    texts, changed = dict(before), 0
    for key, _, removed, kept, _ in substrings(before, 35):
        want = kept if removed else texts[key]
        changed += bool(removed)
        assert after[key]["text"] == want
        if removed:
            assert after[key]["n_chars"] == len(kept)
    assert changed


def test_leaks_go_and_clean_documents_stay(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stages[3]), dict(rows(stages[4]))
    clean = {key for key, _, _, _, hit in benchmark_hits(before, items, 10) if not hit}
    assert set(after) == clean and len(clean) < len(before)
    assert not any(k >= 20_000 for k in after)


def test_every_token_is_packed_once(stages):
    want = {key: ids for key, ids in expected(rows(stages[4]))}
    covered, fill = collections.defaultdict(list), collections.Counter()
    for r in stages[5].collect():
        ids = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        covered[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]] += r["length"]
    for key, ids in want.items():
        at = 0
        for start, length in sorted(covered[key]):
            assert start == at
            at += length
        assert at == len(ids)
    assert all(n == 1024 for k, n in fill.items() if k != max(fill)) and sorted(fill) == list(range(len(fill)))


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
