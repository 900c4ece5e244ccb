import collections
import zlib

import pytest
from pyspark.sql import functions as F

from arborlake.llm.sharding import shard


def check(rows, out, shards):
    assert len(out) == len(rows)
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for i, t, s in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["source"]) for r in out) == want
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots.get(k, ())) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards,cell_rows", [(16, 20_000), (3, 5), (1, 100), (500, 7)])
def test_edge_rows(docs, shards, cell_rows):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    check(rows, shard(docs, shards=shards, cell_rows=cell_rows).collect(), shards)


def test_every_shard_has_the_mixture(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "warm").otherwise(F.concat(F.lit("rare"), (F.col("id") % 40).cast("string"))).alias("source"))
    out = shard(rows, shards=16, cell_rows=500)
    for r in out.groupBy("source").pivot("shard", list(range(16))).count().na.fill(0).collect():
        counts = [r[str(k)] for k in range(16)]
        assert max(counts) - min(counts) <= 3  # a cut falls within a row of each source's own
    # inside a shard the sources are interleaved too
    half = out.filter("shard = 4 AND slot < 900").groupBy("source").count().filter("source = 'hot'").first()["count"]
    assert abs(half - 300) <= 3


def test_many_sources_of_one_row(spark):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("source"))
    out = shard(rows, shards=16, cell_rows=100)
    check([(r["doc_id"], r["text"], r["source"]) for r in rows.collect()], out.collect(), 16)


def test_seed_and_repeat(docs, empty):
    first = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in shard(docs, seed=1).collect()}
    assert first != {(r["doc_id"], r["text_crc32"]): r["shard"] for r in shard(docs, seed=2).collect()}
    assert shard(empty).count() == 0
