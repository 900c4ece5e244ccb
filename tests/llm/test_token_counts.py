import public_tokenizers as files
import pytest
import sentencepiece
from tokenizers import Tokenizer

from arborlake.llm.token_counts import token_counts, version_of
from arborlake.session import scratch_path


def want(name, rows):
    texts = [t or "" for _, t in rows]
    if name.endswith(".model"):
        ids = sentencepiece.SentencePieceProcessor(model_file=files.path(name)).encode(texts)
    else:
        ids = [e.ids for e in Tokenizer.from_file(files.path(name)).encode_batch(texts, add_special_tokens=False)]
    return sorted(((k, len(t.encode()), len(i)) for (k, _), t, i in zip(rows, texts, ids)), key=repr)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_library_s(spark, docs, name):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    done = token_counts(docs, files.path(name), scratch_path(spark, "cache"))
    assert sorted((tuple(r) for r in done.collect()), key=repr) == want(name, rows)


def test_only_misses_are_added(spark, docs):
    cache, one, two = scratch_path(spark, "cache"), files.path("piece_bpe_32k.model"), files.path("byte_bpe_50k.json")
    some = docs.filter("doc_id < 30")
    token_counts(some, one, cache).count()
    first = spark.read.parquet(cache).count()
    assert first == some.select("text").distinct().count()
    token_counts(some, one, cache).count()
    assert spark.read.parquet(cache).count() == first
    again = token_counts(docs, one, cache)
    entries = spark.read.parquet(cache)
    texts = {r["text"] or "" for r in docs.select("text").collect()}
    assert entries.count() == entries.select("digest").distinct().count() == len(texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in again.collect()), key=repr) == want("piece_bpe_32k.model", rows)
    # another tokenizer is another version and shares nothing
    other = token_counts(some, two, cache)
    assert sorted((tuple(r) for r in other.collect()), key=repr) == want("byte_bpe_50k.json", [(r["doc_id"], r["text"]) for r in some.collect()])
    assert {r[0] for r in spark.read.parquet(cache).select("version").distinct().collect()} == {version_of(one), version_of(two)}


def test_a_stored_count_is_used(spark):
    cache, path = scratch_path(spark, "cache"), files.path("piece_bpe_32k.model")
    spark.sql(f"SELECT unhex(sha2('abc', 256)) AS digest, CAST(99 AS BIGINT) AS n_tokens, '{version_of(path)}' AS version").write.partitionBy("version").parquet(cache)
    docs = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "abd")], "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, path, cache).collect()}
    assert found[1] == found[2] == 99 and found[3] < 10


def test_empty(spark, empty):
    assert token_counts(empty, files.path("piece_bpe_32k.model"), scratch_path(spark, "cache")).count() == 0
