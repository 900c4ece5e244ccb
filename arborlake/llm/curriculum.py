"""Time-varying curriculum: sources are mixed to target weights that change in the course of training.

Every class of sources has a weight schedule, a line through knots (time, weight) over the time 0 to 1. The integral of a
schedule is the class's weight in the whole mix and decides the sources' targets. A source's documents stand in a seeded
queue, which is read again when it is used up; the words before a document in that queue are the demand that has to come up
before it is taken. The inverse of the integrated schedule gives the time of that demand, and a range sort by time gives the
training order.

A source may hold most of the rows: its queue is summed in cells of bounded size, shifted by the cells before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranks import number_rows, running_before
from ..session import forget, lookup_join, settle

#: Knots (time, weight) of the classes that sources fall into by turns; their means are 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)), ((0.0, 0.5), (1.0, 1.5)))
REPEATS = 3
CELL_ROWS = 20_000
#: Copies of a repeated row that one row stands for while they are dealt out.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space. Runs become single letters, so no list of words is held."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marked, GAPS, "")).cast("long")


def integrals(knots: Sequence[tuple[float, float]]) -> list[float]:
    """The integrated schedule at its knots."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The earliest time at which the integrated schedule reaches ``share`` (0 to 1) of its whole."""
    sums = integrals(knots)
    asked = share * sums[-1]
    out = F.lit(float(knots[-1][0]))
    for k in reversed(range(len(knots) - 1)):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        more, slope = asked - sums[k], (w1 - w0) / (t1 - t0)
        # root of slope/2 dt^2 + w0 dt = more, in the form that stands slope = 0
        root = w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * more, F.lit(0.0)))
        dt = F.when(more <= 0, F.lit(0.0)).otherwise(2 * more / root)
        out = F.when(asked <= sums[k + 1], F.least(F.lit(t0) + dt, F.lit(float(t1)))).otherwise(out)
    return out


def _checked(schedules) -> list[float]:
    for knots in schedules:
        times = [t for t, _ in knots]
        if len(knots) < 2 or times != sorted(set(times)) or times[0] != 0 or times[-1] != 1 or min(w for _, w in knots) < 0 or integrals(knots)[-1] <= 0:
            raise ValueError("a schedule needs two knots or more, at rising times from 0 to 1, with weights of 0 or more and not all 0")
    return [integrals(knots)[-1] for knots in schedules]


def source_targets(sizes: DataFrame, schedules=SCHEDULES, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (stratum, source_size) with ``kind``, the number of the schedule, and ``target``.

    All sources share the sum of all sizes by weight. A target stops at ``repeats`` times its source's size and the excess is
    shared again by weight. In the order of size to weight the stopped sources come first, so running sums find the level at
    which the rest is shared.
    """
    weights = _checked(schedules)
    # nulls carry the sign "~", which sorts behind the "+" of named sources
    numbered = number_rows(sizes, ["stratum"], "number").withColumn("kind", F.pmod("number", F.lit(len(weights))).cast("int"))
    cap = (F.col("source_size") * repeats).cast("double")
    rows = numbered.withColumns({"weight": F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("kind") + 1), "cap": cap})
    rows = settle(rows.withColumn("ratio", F.col("cap") / F.col("weight")))
    whole = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    summed = running_before(running_before(rows, ["ratio", "number"], "cap", "caps"), ["ratio", "number"], "weight", "weights")
    level = (F.lit(float(whole["size"] or 0)) - F.col("caps")) / (F.lit(float(whole["weight"] or 1)) - F.col("weights"))
    rest = summed.withColumn("level", level).filter("ratio > level").agg(F.min_by("level", F.struct("ratio", "number"))).first()[0]
    target = F.col("cap") if rest is None else F.least("cap", F.lit(rest) * F.col("weight"))
    return settle(rows.select("stratum", "source_size", "kind", target.alias("target")), replaces=rows)


def curriculum(docs: DataFrame, schedules=SCHEDULES, repeats: int = REPEATS, seed: int = 11, text: str = "text", id_col: str = "doc_id",
               source: str = "source", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, code, again, source, size, source_size, target, turn, words, time, step): what training takes, and when.

    A row per use of a row of ``docs``, and a row with ``words`` 0 and no turn, time and step for each that is not used. A
    document's size is its number of words ``[^\\x20\\x09-\\x0D]+``; sources in the order of code points, null last, have the
    schedules by turns. ``turn`` is the pass over the source (from 0, below ``repeats``), ``words`` the words taken from the text's
    beginning: all of them but in the one document in which the demand of its source ends. ``step`` numbers the uses without gaps in
    training order. ``code`` is the hash of id and text and ``again`` numbers rows that agree in id, text and source, so that
    (doc_id, code, source, again) is one row of ``docs``.

    Defined results: a null or blank text has size 0 and is not used; a null source is a source of its own; a null id is an
    id; repeated rows are rows of their own; very long texts are counted where they are read and never moved; equal times are
    ordered by source, turn and queue; an empty table gives an empty table; other columns are not read. The result depends on the rows
    and the seed alone.
    """
    spark = docs.sparkSession
    if not (isinstance(repeats, int) and repeats > 0):
        raise ValueError("repeats has to be a whole number above 0")
    stratum = F.when(F.col(source).isNull(), "~").otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))
    slim = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), word_count(F.col(text)).alias("size"), F.xxhash64(id_col, text).alias("code"))
    # rows that agree would all fall into one cell, so each gets a number, and a hash of its own
    each = slim.groupBy("doc_id", "stratum", "size", "code").agg(F.count(F.lit(1)).alias("m"))
    dealt = each.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / CHUNK)))).repartition("doc_id", "code", "chunk")
    first = F.col("chunk") * CHUNK
    rows = dealt.withColumn("again", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("m")) - 1))).drop("m", "chunk")
    rows = settle(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "code", "again", "stratum")))

    cells = max(-(-rows.count() // cell_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows_in = rows.withColumn("cell", F.pmod(F.col("h"), F.lit(cells)))
    summed = settle(rows_in.groupBy("stratum", "cell").agg(F.sum("size").alias("n")))
    targets = source_targets(summed.groupBy("stratum").agg(F.sum("n").alias("source_size")), schedules, repeats)
    before = settle(running_before(summed, ["stratum", "cell"], "n", "before").select("stratum", "cell", "before"))
    base = lookup_join(before, before.groupBy("stratum").agg(F.min("before").alias("base")), "stratum")
    starts = settle(lookup_join(base, targets, "stratum").select("stratum", "cell", (F.col("before") - F.col("base")).alias("before"), "source_size", "kind", "target"))

    earlier = Window.partitionBy("stratum", "cell").orderBy("h", "doc_id", "code", "again", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = rows_in.withColumn("at", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    queued = lookup_join(queued, starts, ["stratum", "cell"], salt_by=["h"]).withColumn("at", F.col("at") + F.col("before"))

    wanted = F.floor("target")
    uses = []
    for turn in range(repeats):
        begin = F.col("at") + F.lit(turn) * F.col("source_size")
        words = F.greatest(F.least(wanted - begin, F.col("size")), F.lit(0)).cast("long")
        uses.append(F.struct(F.lit(turn).alias("turn"), words.alias("words"), begin.alias("begin")))
    used = F.filter(F.array(*uses), lambda u: u["words"] > 0)
    taken = queued.withColumn("use", F.explode_outer(used))
    share = F.col("use.begin") / F.col("target")
    time = F.lit(None).cast("double")
    for kind, knots in enumerate(schedules):
        time = F.when(F.col("kind") == kind, time_of(share, knots)).otherwise(time)
    taken = settle(taken.select(
        "doc_id", "code", "again", "stratum", "size", "source_size", "target", F.col("use.turn").alias("turn"),
        F.coalesce("use.words", F.lit(0)).alias("words"), time.alias("time"), "h"))
    used = number_rows(taken.filter("words > 0"), ["time", "stratum", "turn", "h", "doc_id", "code", "again"], "step")
    out = used.unionByName(taken.filter("words = 0").withColumn("step", F.lit(None).cast("long")))
    for frame in (rows, summed, before, targets, starts):
        forget(frame)
    back = F.when(F.col("stratum") != "~", F.substr("stratum", F.lit(2)))
    return out.select("doc_id", "code", "again", back.alias("source"), "size", "source_size", "target", "turn", "words", "time", "step")


def training_rows(docs: DataFrame, mix: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(step, doc_id, text): the texts in training order, cut after the words that are taken; sorted inside and across partitions."""
    uses = mix.filter("words > 0").select("step", "words", "size", F.col("doc_id").alias("_id"), "code")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(id_col, text).alias("_code")).dropDuplicates(["doc_id", "_code"])
    found = uses.join(texts, (F.col("code") == F.col("_code")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    # cut at the ends of words; what follows the last one that is taken is the last piece
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", F.col("words").cast("int") + 1)
    cut = F.left("text", F.length("text") - F.length(F.element_at(pieces, -1)))
    return found.select("step", "doc_id", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")).alias("text")).repartitionByRange("step").sortWithinPartitions("step")
