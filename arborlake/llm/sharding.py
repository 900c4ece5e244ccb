"""Proportional stratified interleaving: every shard gets every source in the collection's proportions.

Rows of a source are shuffled by a seeded hash and ranked; the rank divided by the source's size is its fractional rank.
Sorting all rows by fractional rank interleaves the sources evenly, and cutting that order into runs of equal length gives shards
whose mixture matches the whole to within a few rows per source.

Neither ranking is a window over a source or over the table. Hashes are cut into cells of bounded size; a cell's rows are
ranked on their own and shifted by the sizes of the cells before it. The same is done along the fractional rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranks import running_before
from ..session import fits_broadcast, settle

CELL_ROWS = 20_000


def _table(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def _unit(h: Column) -> Column:
    """A hash as a number in [0, 1), its 53 low bits."""
    return h.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def shard(docs: DataFrame, shards: int = 16, seed: int = 7, text: str = "text", id_col: str = "doc_id", source: str = "source", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): where each row of ``docs`` goes.

    Shards hold numbers of rows at most one apart; slots run from 0 without gaps inside a shard, in interleaved order.
    ``size`` is the UTF-8 length of the text plus 1 and ``text_crc32`` the CRC-32 of its UTF-8 bytes.

    Defined results: a very long text is one row, measured where it is read;
    a null text has size 1 and the CRC of nothing; a null source is a source of its own; equal
    fractional ranks are ordered by source, hash, id, CRC and size, and rows that agree on all of them are alike, so
    either may come first; copies of a text are spread like any other rows; an empty table gives an empty table; fewer rows
    than shards leave the later shards empty; other columns are not read.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    named = F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))
    slim = docs.select(
        F.col(id_col).alias("doc_id"), named.alias("stratum"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    slim = settle(slim.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")))
    total = slim.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(-(-total // cell_rows), parts)

    # rank inside the source: cell by cell along the hash
    rows = slim.withColumn("cell", F.floor(_unit(F.col("h")) * cells))
    sizes = settle(rows.groupBy("stratum", "cell").agg(F.count(F.lit(1)).alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sizes.groupBy("stratum").agg(F.sum("n").alias("all"))
    starts = settle(sizes.withColumn("before", before).join(whole, "stratum").select("stratum", "cell", "before", "all"))
    inside = Window.partitionBy("stratum", "cell").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("r", F.row_number().over(inside)).join(_table(starts), ["stratum", "cell"])
    # a source's own phase keeps many small sources from meeting at the same place
    phase = _unit(F.xxhash64(F.lit(seed), "stratum"))
    ranked = ranked.withColumn("at", (F.col("before") + F.col("r") - phase) / F.col("all"))

    # place among all rows: cell by cell along the fractional rank
    placed = settle(ranked.select("doc_id", "stratum", "size", "text_crc32", "h", "at", F.floor(F.col("at") * cells).alias("cell")))
    sizes = settle(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    starts = running_before(sizes, ["cell"], "n", "before").select("cell", "before")
    inside = Window.partitionBy("cell").orderBy("at", "stratum", "h", "doc_id", "text_crc32", "size")
    out = placed.withColumn("r", F.row_number().over(inside)).join(_table(starts), "cell")
    place = F.col("before") + F.col("r") - 1
    least, more = divmod(total, shards)
    # the first ``more`` shards hold one row more
    edge = more * (least + 1)
    number = F.when(place < edge, F.floor(place / F.lit(least + 1))).otherwise(more + F.floor((place - edge) / F.lit(max(least, 1))))
    first = F.when(number < more, number * (least + 1)).otherwise(edge + (number - more) * least)
    back = F.when(F.col("stratum") != "-", F.substr("stratum", F.lit(2)))
    return out.select(
        "doc_id", back.alias("source"), "size", "text_crc32", number.cast("int").alias("shard"), (place - first).cast("long").alias("slot"))
