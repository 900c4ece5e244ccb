"""Spelling variants: words one error apart, found by search schemes over FM-indexes of the vocabulary.

One error leaves one half of a word as it is. A word is asked for under its first half and under its second, and every word
of a length that may answer stands under those halves too. Halves are dealt into blocks; a block holds an index over its words,
and the search meets the half exactly and goes across the other half with one error (``fm_index``).

A half that more than ``MEMBERS`` words share is refined by the same argument: the part that holds the error is cut in two, one
of which is exact, so the key grows until few words share it and no pair is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import forget, lookup_join, settle
from .common import bounded_batches
from .fm_index import BidirectionalIndex

LEAST = 7
MEMBERS = 20_000
BLOCK_POINTS = 400_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"


def vocabulary(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = LEAST, seldom: int = 2, spoil: int = 31) -> DataFrame:
    """(word, n): the words of at least ``least`` code points that occur ``seldom`` times or more.

    A word is a maximal run of ``A-Za-z\\u00C0-\\u00FF`` with A-Z lower-cased. With ``spoil`` above 0 a slip is planted: where ``spoil``
    divides the CRC-32 h of ``<id>:<word>``, the code point h % length is deleted (a null id counts as empty).
    """
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    word = F.translate("run", CAPITALS, SMALL)
    if spoil:
        runs = runs.select(word.alias("run"), F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary")).alias("h"))
        at = F.pmod("h", F.length("run")).cast("int")
        word = F.when(F.pmod("h", F.lit(spoil)) == 0, F.concat(F.left("run", at), F.substr("run", at + 2))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= seldom)


def _spans(length: Column, depth: int) -> list[tuple[Column, Column]]:
    """The parts [a, b) of a word that may hold the error, the rest being exact: two halves, four quarters, and so on.

    Even numbers are right of the odd one that follows; the first half of the list lies in the word's second half.
    """
    half = F.floor(length / 2).cast("int")
    spans = [(half, length), (F.lit(0), half)]
    for _ in range(depth):
        cut = [(a, b, F.floor((a + b) / 2).cast("int")) for a, b in spans]
        spans = [span for a, b, m in cut for span in ((m, b), (a, m))]
    return spans


def _keys(word: str, change: int, depth: int) -> list[Column]:
    """The hash of what is exact around each span, for words asked for that are ``change`` code points shorter than this one."""
    size = F.length(word)
    asked = (size - change).cast("int")
    return [
        F.xxhash64(F.lit(depth), F.lit(k), F.left(word, a), F.substr(word, F.greatest(size - asked + b, F.lit(0)) + 1))
        for k, (a, b) in enumerate(_spans(asked, depth))
    ]


def _keyed(words: DataFrame, depth: int) -> DataFrame:
    """(word, n, above, key, side): a row per key of a word; ``above`` is the key a level up.

    ``side`` is 1 where the word is asked for under its first half, 2 for its second, 0 where it only may answer.
    """
    own = _keys("word", 0, depth)
    rows = []
    for change in (0, -1, 1):
        up = _keys("word", change, depth - 1) if depth else [F.lit(None).cast("long")] * len(own)
        for k, key in enumerate(_keys("word", change, depth)):
            side = F.lit(0) if change else F.lit(1 if k < len(own) // 2 else 2)
            rows.append(F.struct(up[k // 2 if depth else k].alias("above"), key.alias("key"), side.alias("side")))
    once = words.select("word", "n", F.explode(F.array(*rows)).alias("k")).select("word", "n", "k.*")
    return once if depth else once.drop("above")


def _routes(words: DataFrame, members: int) -> DataFrame:
    """(word, n, key, side): every word under all keys where it is asked for or may answer, none of them crowded."""
    out, depth = None, 0
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    rows = settle(_keyed(words, 0))
    while True:
        finest = longest >> (depth + 1) < 2
        crowded = None if finest else settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > members).select("key"))
        more = crowded is not None and bool(crowded.limit(1).count())
        kept = lookup_join(rows, crowded, "key", "left_anti") if more else rows
        out = kept if out is None else out.unionByName(kept)
        if not more:
            return out
        depth += 1
        inside = lookup_join(rows, crowded, "key", "left_semi").select("word", "n").distinct()
        finer = _keyed(inside, depth).withColumnRenamed("key", "finer").withColumnRenamed("above", "key")
        rows = settle(lookup_join(finer, crowded, "key", "left_semi").select("word", "n", F.col("finer").alias("key"), "side"))


def _search(table: pa.Table) -> pa.Table:
    """All answers to the words asked for in one block."""
    words = pc.dictionary_encode(table.column("word").combine_chunks())
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    which, side = words.indices.to_numpy(), table.column("side").to_numpy()
    names = words.dictionary
    n = np.zeros(len(names), np.int64)
    n[which] = table.column("n").to_numpy()
    points = np.frombuffer("".join(names.to_pylist()).encode("utf-32-le"), np.uint32)
    index = BidirectionalIndex(points, pc.utf8_length(names).to_numpy())
    found = [index.one_error(np.unique(which[side == s]), s == 1) for s in (1, 2)]
    a, b = (np.concatenate(x) for x in zip(*found))
    return pa.table({"word": names.take(pa.array(a)), "other": names.take(pa.array(b)), "other_n": pa.array(n[b])})


def near_words(words: DataFrame, members: int = MEMBERS, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(word, other, other_n): all ordered pairs of words, distinct and not empty, that one inserted, deleted or replaced code point tells apart.

    ``words`` has (word, n), one row per word.
    """
    spark = words.sparkSession
    bounded_batches(spark)
    rows = settle(_routes(words, members))
    points = rows.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    blocks = max(-(-points // block_points), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.withColumn("block", F.pmod("key", F.lit(blocks))).groupBy("block").applyInArrow(_search, "word string, other string, other_n long")
    # dealt by word once, which serves the distinct pairs here and a grouping by word
    return settle(found.repartition("word").dropDuplicates(["word", "other"]), replaces=rows)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from (word, form) the last word that forms lead to, by doubling the paths; there are no circles."""
    state = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        table = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settle(lookup_join(state, table, "root", "left", salt_by=["word"]))
        if not stepped.filter("next IS NOT NULL").limit(1).count():
            forget(stepped)
            return state
        state = settle(stepped.select("word", F.coalesce("next", "root").alias("root")), replaces=state)
        forget(stepped)


def spelling_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = LEAST, seldom: int = 2, spoil: int = 31,
                    times: int = 10, members: int = MEMBERS, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts and the usual spelling of each.

    Words are those of ``vocabulary``. Two are near if one inserted, deleted or replaced code point tells them apart. A word's form is
    its near word of largest n (of equals the first by code points) if that is at least ``times`` the word's n. ``root`` is
    where forms lead; a word without a form is its own root.

    Defined results: null, empty and blank texts have no words; a null id counts as empty; repeated rows count as often as
    they occur; very long texts are cut into words where they are read, and very long words are words; an empty table
    gives an empty table; other columns are not read.
    """
    if times <= 1:
        raise ValueError("times has to be above 1: forms must not lead in circles")
    words = settle(vocabulary(docs, text, id_col, least, seldom, spoil))
    pairs = near_words(words, members, block_points)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    usual = -F.col("best.less") >= times * F.col("n")
    found = settle(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best.word")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n")), replaces=words)
    forget(pairs)
    led = roots(found.filter("form IS NOT NULL"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
