"""Global ordinals and running totals without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

_POSITION_BITS = 33


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows written once in range order, with the partition number and the position inside it."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return settle(ordered).withColumns({
        "_part": F.shiftright("_id", _POSITION_BITS).cast("int"),
        "_pos": F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1).cast("long")),
    }).drop("_id")


def _offsets(totals: dict[int, float], zero) -> Column:
    """Sum of all earlier partitions, as a literal list with one entry per partition."""
    out, running = [], zero
    for part in range(max(totals, default=-1) + 1):
        out.append(running)
        running += totals.get(part, zero)
    return F.element_at(F.array(*[F.lit(v) for v in out] or [F.lit(zero)]), F.col("_part") + 1)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "number", start: int = 0) -> DataFrame:
    """``row_number() over (order by …)``: ranges are sorted in parallel, then shifted by the earlier ranges.

    ``order`` has to be unique per row for a fixed result.
    """
    rows = _ranged(df, order)
    totals = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    return rows.withColumn(name, F.col("_pos") + _offsets(totals, 0).cast("long") + F.lit(start)).drop("_part", "_pos")


def running_before(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows that sort earlier."""
    rows = _ranged(df, order)
    totals = {r["_part"]: r["s"] for r in rows.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    zero = 0.0 if dict(df.dtypes)[value] == "double" else 0
    earlier = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(earlier), F.lit(zero))
    return rows.withColumn(name, inside + _offsets(totals, zero)).drop("_part", "_pos")
