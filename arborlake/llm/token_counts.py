"""Token counts through a digest cache: a text is encoded once per tokenizer version, whoever asks for it.

The cache is a table of (digest, version, n_tokens). Rows look their digest up; the distinct digests that miss are encoded, one
text each, and appended; all rows are answered from the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import bounded_batches, slices

SLICE_BYTES = 4 << 20
CACHE = "digest binary, version string, n_tokens long"


def version_of(path: str) -> str:
    """Digest of the tokenizer's file: another file is another version."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32]


def normalised(text: Column) -> Column:
    """What the count depends on: a null text counts as an empty one; all else is left to the tokenizer itself."""
    return F.coalesce(text, F.lit(""))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)

            def count(texts):
                return [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()

            def count(texts):
                return [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column("text")), SLICE_BYTES):
                found = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(found, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per row of ``docs``; ``cache`` is a folder that all executors share.

    The count is that of the library of the file at ``tokenizer`` (``.model`` sentencepiece, ``.json`` tokenizers) for the whole
    text, without begin, end or added special tokens, truncation or padding; special strings inside a text are what the
    library's default makes of them.

    Defined results: very long texts are encoded whole;
    a null text is an empty one, with 0 bytes; repeated rows and equal texts share one entry of the cache;
    a digest that two jobs add at once is an entry twice with the same count and is read once; entries of other versions
    are not read; an empty table gives an empty table and adds nothing; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    version = version_of(tokenizer)
    whole = normalised(F.col(text))
    digest = F.unhex(F.sha2(whole, 256))
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("version").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version).select("digest", "n_tokens")
    if stored.limit(1).count():
        asked = docs.select(digest.alias("digest"), whole.alias("text")).join(stored, "digest", "left_anti")
    else:
        asked = docs.select(digest.alias("digest"), whole.alias("text"))
    misses = asked.groupBy("digest").agg(F.first("text").alias("text"))
    counted = misses.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    counted.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
    answers = settle(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), digest.alias("digest"))
    return rows.join(answers, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
