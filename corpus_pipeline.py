"""From raw documents to packed token windows in five stages, each one operator of ``arborlake.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm.common import same
from arborlake.llm.decontaminate import occurrences
from arborlake.llm.language_id import fit, language_id
from arborlake.llm.near_copies import similar_groups
from arborlake.llm.queries import packed_rows, table
from arborlake.llm.simhash import keep_one, near_groups
from arborlake.llm.substring_dedup import dedup_substrings
from arborlake.operators.components import connected_components
from arborlake.session import forget, lookup_join, settle

#: No SQL expresses hashing tokenizers, deficit queues or trigram models; the tests hold each stage against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents that are not in ``gone`` (id, code), where code is the hash of id and text."""
    gone = settle(gone.select(F.col(gone.columns[0]).alias("_id"), F.col("code").alias("_code")).distinct())
    code = F.xxhash64("doc_id", "text")
    return docs.join(gone, (code == F.col("_code")) & same(F.col("doc_id"), F.col("_id")), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the labelled languages; texts without letters or in none of them go."""
    named = language_id(docs, fit(docs), host=F.col("source"), declared="lang")
    return _without(docs, named.filter("rejected").select("id", "code"))


def joined_groups(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, component_id) of groups that documents of either table join; rows without an id follow both of theirs."""
    first, second = settle(first.select("doc_id", "component_id")), settle(second.select("doc_id", "component_id"))
    both = first.unionByName(second)
    links = both.filter("doc_id <> component_id").select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst")).distinct()
    links = settle(links)
    linked = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    table = settle(connected_components(linked, links).select(F.col("id").alias("component_id"), F.col("component")))
    rows = first.filter("doc_id IS NOT NULL").unionByName(both.filter("doc_id IS NULL"))
    own = rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return lookup_join(own, table, "component_id", "left", salt_by=["doc_id"]).select("doc_id", F.coalesce("component", "component_id").alias("component_id"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group linked by fingerprints or by a Jaccard similarity of 0.8.

    The operator's fingerprints link at two or fewer bits. Majority bits would need a radius of about twelve for a similarity of
    0.8 and still miss short texts, so sets of five-word shingles add their links; a group is what links of either kind reach.
    """
    return keep_one(docs, joined_groups(near_groups(docs), similar_groups(docs)))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; where windows of 35 words occur elsewhere too, the text is what is left without them."""
    done = dedup_substrings(docs, window=35)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, and no whole shorter item, with the benchmark."""
    return _without(docs, occurrences(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "code"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens."""
    return packed_rows(docs)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
