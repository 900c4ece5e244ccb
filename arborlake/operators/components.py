"""Connected components by label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import forget, lookup_join, settle


def _relabel(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Replace a label by the label of that label. The table holds only labels in use, one row each."""
    out = lookup_join(rows.withColumnRenamed(column, "_key"), table, "_key", "left", salt_by=["id"])
    return out.withColumn(column, F.coalesce("_new", "_key")).drop("_key", "_new")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each component.

    A round takes the smallest neighbouring label, hooks the old label's own vertex to it and halves the pointer
    paths, so the number of rounds grows with the logarithm of the diameter. State is written once per round.
    """
    both = settle(
        edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        .filter("src <> dst").distinct()
    )
    state = settle(vertices.select("id").distinct().withColumn("component", F.col("id")))
    while True:
        label = state.select(F.col("id").alias("dst"), F.col("component").alias("other"))
        nearest = both.join(label, "dst").groupBy(F.col("src").alias("id")).agg(F.min("other").alias("near"))
        seen = state.join(nearest, "id", "left").withColumn("low", F.least("component", "near"))
        hooks = seen.filter("low < component").groupBy(F.col("component").alias("id")).agg(F.min("low").alias("hook"))
        hooked = seen.join(hooks, "id", "left").select("id", F.least("low", "hook").alias("component"), F.col("component").alias("old"))
        hooked = settle(hooked)
        if not hooked.filter("component <> old").limit(1).count():
            return hooked.select("id", "component")
        pointers = hooked.select("id", "component")
        used = pointers.select(F.col("component").alias("id")).distinct()
        jump = pointers.join(used, "id", "left_semi").select(F.col("id").alias("_key"), F.col("component").alias("_new"))
        state = settle(_relabel(pointers, "component", jump), replaces=state)
        forget(hooked)
