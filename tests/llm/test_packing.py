import collections
import zlib

import numpy as np
import public_tokenizers as files
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborlake.llm import packing
from arborlake.llm.packing import Encoder, pack, sequences

PATH, RANKS = files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken")


def expected(rows):
    found = Tokenizer.from_file(PATH).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return [(key, np.array([*e.ids, 0], "<u4")) for (key, _), e in zip(rows, found)]


@pytest.mark.parametrize("window,quantum,chunk", [(1024, 128, 1 << 20), (64, 16, 1 << 11), (32, 128, 1 << 10)])
def test_every_id_once_and_windows_full(docs, monkeypatch, window, quantum, chunk):
    monkeypatch.setattr(packing, "CHUNK_TOKENS", chunk)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pieces = pack(docs, PATH, RANKS, files.PATTERN, window=window, quantum=quantum).collect()
    filled = collections.defaultdict(list)
    covered = collections.defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] > 0
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    assert sorted(filled) == list(range(len(filled)))
    for k, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or k == len(filled) - 1
    whole = expected(rows)
    assert sum(len(ids) for _, ids in whole) == sum(r["length"] for r in pieces)
    # pieces of rows that share an id and a length are told apart by their contents
    want = collections.Counter()
    for key, ids in whole:
        want[key, len(ids)] += 1
    for (key, n), parts in covered.items():
        assert sum(len(b) for _, b in parts) == 4 * n * want[key, n]
        texts = {ids.tobytes() for k, ids in whole if k == key and len(ids) == n}
        assert all(any(t[4 * s:4 * s + len(b)] == b for t in texts) for s, b in parts)


def test_shares_hold_over_any_run_of_windows(spark):
    rows = [(k, " ".join(["word"] * (30 + k % 50)), ["a", "a", "a", "b", "c"][k % 5]) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = pack(docs, PATH, RANKS, files.PATTERN, window=256, quantum=64).join(docs.select("doc_id", "source"), "doc_id")
    total = pieces.agg(F.sum("length")).first()[0]
    shares = {r["source"]: r["n"] / total for r in pieces.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    run, worst = collections.Counter(), 0.0
    by_window = collections.defaultdict(collections.Counter)
    for r in pieces.collect():
        by_window[r["sequence_id"]][r["source"]] += r["length"]
    for k in sorted(by_window):
        run += by_window[k]
        worst = max(worst, max(abs(run[s] - shares[s] * 256 * (k + 1)) for s in shares))
    assert worst <= 256 + 64


def test_targets(spark):
    rows = [(k, " ".join(["word"] * 60), "ab"[k % 2]) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = pack(docs, PATH, window=256, quantum=32, targets={"a": 0.75, "b": 0.25}).join(docs.select("doc_id", "source"), "doc_id")
    first = {r["source"]: r["n"] for r in pieces.filter("sequence_id < 100").groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert abs(first["a"] / (100 * 256) - 0.75) < 0.01
    assert pieces.agg(F.sum("length")).first()[0] == docs.count() * 61


def test_sequences_are_padded_unless_a_power_of_two(docs):
    pieces = pack(docs, PATH, RANKS, files.PATTERN, window=64, quantum=16)
    done = sequences(pieces, window=64, pad_id=7).collect()
    assert sum(r["n_tokens"] for r in done) == pieces.agg(F.sum("length")).first()[0]
    for r in done:
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 64)
    one = {r["sequence_id"]: bytes(r["ids"]) for r in done}
    for r in pieces.filter("sequence_id = 3").collect():
        assert one[3][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
        assert zlib.crc32(bytes(r["ids"])) == spark_crc(docs, bytes(r["ids"]))


def spark_crc(docs, data):
    return docs.sparkSession.range(1).select(F.crc32(F.lit(bytearray(data)))).first()[0]


def test_both_libraries_agree(texts):
    one, two = Encoder(PATH, RANKS, files.PATTERN), Encoder(PATH)
    hard = [t or "" for t in texts] + ["".join(map(chr, range(1, 0x250))), "  \u0085 x", "a  b   c\n\n d", "it's we'll 12345 x²½", "ǅ ʼn"]
    hard += [a + chr(c) + b for c in range(1, 0x250) for a, b in (("a ", " b"), ("1", "1"), ("  ", "!"), ("'", "s"))]
    for a, b in zip(one.encode(hard), two.encode(hard)):
        assert a.tolist() == b.tolist()


def test_empty(empty):
    assert pack(empty, PATH).count() == 0
