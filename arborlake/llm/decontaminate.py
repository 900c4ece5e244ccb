"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words are hashed, ``GRAM`` consecutive hashes make a gram, and the smallest gram of every ``WINDOW - GRAM + 1``
consecutive ones is kept as a fingerprint of the text. A span of ``WINDOW`` words that a document shares with an item
holds the same grams on both sides, so both keep the same smallest one: no such span is missed. Documents whose
fingerprints meet an item's are visited again; each hit is extended to all windows around it, and a window counts when
its words are those of an item's window, compared as text. Items of fewer words than a window are one gram as long as
the item.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import fits_broadcast, settle
from .common import same

WINDOW = 10
GRAM = 5
#: ASCII apart from digits and letters; all else belongs to words.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A word before its letters are lower-cased.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; no other letter changes. Null: no words."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BREAKS), "")


def _grams(codes: Column, k: int) -> Column:
    """Hash of every run of k word hashes."""
    full = F.transform(codes, lambda x, i: F.xxhash64(x, *[F.get(codes, i + j) for j in range(1, k)]))
    return F.slice(full, 1, F.greatest(F.size(codes) - (k - 1), F.lit(0)))


def _winnowed(grams: Column, w: int) -> Column:
    """The smallest of every w consecutive grams. Runs cut short by the end are kept too, which adds a few."""
    return F.transform(grams, lambda x, i: F.least(x, *[F.get(grams, i + j) for j in range(1, w)])) if w > 1 else grams


def _classes(lengths: list[int], window: int, gram: int) -> list[tuple[int, int]]:
    """(words of a window, words of a gram) for full windows and for each length of shorter items."""
    return [(window, min(gram, window))] + [(m, m) for m in lengths]


def _with_grams(rows: DataFrame, classes: list[tuple[int, int]]) -> DataFrame:
    rows = rows.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumns({f"g{W}": _grams(F.col("codes"), k) for W, k in classes})


def _places(window: int, gram: int) -> Column:
    """(start, end, span) of every window of a document that covers one of the grams in ``prints``."""
    hit = F.filter(F.transform(F.col(f"g{window}"), lambda g, i: F.when(F.array_contains("prints", g), i)), lambda i: i.isNotNull())
    around = F.flatten(F.transform(hit, lambda i: F.sequence(F.greatest(i - (window - gram), F.lit(0)), i)))
    valid = F.filter(F.array_distinct(around), lambda d: d <= F.size("words") - window)
    return F.transform(valid, lambda d: F.struct(
        d.cast("long").alias("start"), (d + window).cast("long").alias("end"), F.concat_ws(" ", F.slice("words", d + 1, window)).alias("span")))


def _met(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Join with a table made from the benchmark: broadcast if its counted size is small, else shuffled."""
    return rows.join(F.broadcast(table) if fits_broadcast(table) else table, on)


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text",
                item_id: str = "item_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, code, start, end, item): every place where a window of an item occurs. ``code`` is the hash of id and text."""
    listed = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    listed = settle(listed)
    short = sorted(r[0] for r in listed.select(F.size("words")).filter(F.size("words") < window).distinct().collect())
    classes = _classes(short, window, gram)
    n = F.size("words")

    kept = [F.when(n >= window, _winnowed(F.col(f"g{window}"), window - classes[0][1] + 1))]
    kept += [F.when(n == m, F.col(f"g{m}")) for m in short]
    prints = settle(_with_grams(listed, classes).select(F.explode(F.coalesce(*kept)).alias("print")).distinct())
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array(F.lit(1)))
    spans = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("words", i, window)))
    windows = settle(listed.select("item", F.explode(spans).alias("span")).distinct())

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.col(text)).alias("code"))
    marks = [_winnowed(F.col(f"g{W}"), W - k + 1) for W, k in classes]
    first = _with_grams(rows.select("doc_id", "code", words_of(F.col("text")).alias("words")), classes)
    first = first.select("doc_id", "code", F.explode(F.array_distinct(F.concat(*marks))).alias("print"))
    hits = settle(_met(first, prints, "print").groupBy("doc_id", "code").agg(F.collect_set("print").alias("prints")))

    found = hits.select(F.col("doc_id").alias("_id"), F.col("code").alias("_code"), "prints")
    again = rows.join(found, same(F.col("doc_id"), F.col("_id")) & (F.col("code") == F.col("_code")))
    again = _with_grams(again.select("doc_id", "code", "prints", words_of(F.col("text")).alias("words")), classes)
    places = [_places(W, k) for W, k in classes]
    checked = again.select("doc_id", "code", F.inline(F.concat(*places)))
    return _met(checked, windows, "span").select("doc_id", "code", "start", "end", "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text",
                  item_id: str = "item_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, code, n_words, n_hit, items, contaminated), one row per row of ``docs``.

    A-Z is lower-cased; words are runs of digits, a-z and non-ASCII characters. A window is ``window`` consecutive
    words of an item; an item of fewer words is one window. ``n_hit`` counts the document's words inside any occurrence
    of any window, ``items`` lists the ids of the items with one, sorted as strings.

    Defined results: very long texts are searched whole;
    null and empty texts have no words and no windows; repeated documents are rows with equal
    results; repeated item rows count once; an item without id marks words but is not listed; an empty benchmark or
    document table gives no hits or no rows; other columns are not read.
    """
    found = settle(occurrences(docs, items, text, id_col, item_text, item_id, window, gram))
    earlier = Window.partitionBy("doc_id", "code").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc_id", "code", "start", "end").distinct().withColumn("reached", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    fresh = F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("start", "reached"))
    counts = spans.groupBy("doc_id", "code").agg(F.sum(fresh).alias("n_hit"))
    named = found.groupBy("doc_id", "code").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = counts.alias("c").join(named.alias("i"), same(F.col("c.doc_id"), F.col("i.doc_id")) & (F.col("c.code") == F.col("i.code")))
    result = settle(both.select(F.col("c.doc_id").alias("_id"), F.col("c.code").alias("_code"), "n_hit", "items"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("code"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(result, same(F.col("doc_id"), F.col("_id")) & (F.col("code") == F.col("_code")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "code", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))
