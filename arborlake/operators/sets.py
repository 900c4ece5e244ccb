"""Neuron sets by rule, tag groups, table summaries and stored cluster assignments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import natural_key
from ..session import settle
from .filters import AnnotationRule, annotation_test


@dataclass(frozen=True)
class NeuronSet:
    """A named rule; its members are always computed, never stored."""

    name: str
    rule: AnnotationRule


def set_members(entries: DataFrame, sets: Sequence[NeuronSet]) -> DataFrame:
    """(set_name, file_id) for all rules in one pass over the annotations."""
    names = F.array(*[F.when(annotation_test(s.rule), F.lit(s.name)) for s in sets])
    return entries.select(F.explode(F.filter(names, lambda n: n.isNotNull())).alias("set_name"), "file_id").distinct()


def save_set(sets: Sequence[NeuronSet], added: NeuronSet) -> tuple[NeuronSet, ...]:
    """Add a set or replace the one of the same name."""
    if not added.name.strip():
        raise ValueError("a set needs a name")
    return (*[s for s in sets if s.name != added.name], added)


def tag_groups(entries: DataFrame) -> DataFrame:
    """(tag_key, neurons): identical tag sets in natural order of their tags; untagged last as an empty key."""
    tags = F.array_distinct(F.coalesce(F.col("tags"), F.array().cast("array<string>")))
    keyed = F.transform(tags, lambda t: F.struct(natural_key(t).alias("k"), t.alias("t")))
    rows = entries.select("file_id", F.transform(F.array_sort(keyed), lambda s: s["t"]).alias("tag_list"))
    key = F.array_join("tag_list", ",").alias("tag_key")
    return rows.groupBy("tag_list", key).agg(F.count_distinct("file_id").alias("neurons")).orderBy(
        F.size("tag_list") == 0, F.transform("tag_list", natural_key)
    )


def table_summary(table: DataFrame) -> DataFrame:
    """Rows, added, visible and neurons per cluster, unclustered last: (section, key, value)."""
    folded = table.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("added", F.lit(False))).alias("added"),
        F.count_if(F.coalesce("visible", F.lit(False))).alias("visible"),
    )
    totals = folded.agg(F.sum("n").alias("rows"), F.sum("added").alias("added"), F.sum("visible").alias("visible")).select(
        F.expr("stack(3, 'rows', rows, 'added', added, 'visible', visible) AS (section, value)"))
    clusters = folded.select(F.lit("cluster").alias("section"), F.col("label").alias("key"), F.col("n").alias("value"))
    return totals.select("section", F.lit(None).cast("int").alias("key"), "value").unionByName(clusters).orderBy(
        F.col("section") == "cluster", F.asc_nulls_last("key")
    )


# --- stored runs

@dataclass(frozen=True)
class Assignments:
    """Named clustering runs: labels, cohorts and one row of facts per run."""

    labels: DataFrame  # assignment_id, file_id, label
    cohort: DataFrame  # assignment_id, file_id
    runs: tuple[dict, ...] = ()

    def add(self, assignment_id: str, labels: DataFrame, cohort: DataFrame, name: str, column: str, **facts) -> Assignments:
        """Append a run; its labels and cohort become part of the tables. Id, name and column must be new."""
        run = {"assignment_id": assignment_id, "name": name.strip(), "column_name": column, **facts}
        self._refuse_twins(run)
        own = F.lit(assignment_id).alias("assignment_id")
        rows = labels.filter("label IS NOT NULL").select(own, F.col("file_id").cast("string").alias("file_id"), F.col("label").cast("int").alias("label"))
        scope = cohort.select(own, F.col("file_id").cast("string").alias("file_id")).distinct()
        return Assignments(self.labels.unionByName(rows), self.cohort.unionByName(scope), (*self.runs, run))

    def _refuse_twins(self, run: dict) -> None:
        """Runs differ in id, name and column, whatever their case, and none of these is blank."""
        for key in ("assignment_id", "name", "column_name"):
            if not run[key] or any(r[key].lower() == run[key].lower() for r in self.runs):
                raise ValueError(f"{key} {run[key]!r} is blank or in use")

    def drop(self, assignment_id: str) -> Assignments:
        keep = F.col("assignment_id") != assignment_id
        return Assignments(self.labels.filter(keep), self.cohort.filter(keep), tuple(r for r in self.runs if r["assignment_id"] != assignment_id))

    def rename(self, assignment_id: str, name: str) -> Assignments:
        (run,) = (r for r in self.runs if r["assignment_id"] == assignment_id)
        others = Assignments(self.labels, self.cohort, tuple(r for r in self.runs if r is not run))
        changed = run | {"name": name.strip()}
        others._refuse_twins(changed)
        return Assignments(self.labels, self.cohort, tuple(changed if r is run else r for r in self.runs))

    def of(self, assignment_id: str) -> DataFrame:
        return self.labels.filter(F.col("assignment_id") == assignment_id).select("file_id", "label")

    def label_map(self, assignment_id: str, cohort: DataFrame | None = None) -> DataFrame:
        """Label per file of a cohort (by default the run's own), null if unassigned."""
        if cohort is None:
            cohort = self.cohort.filter(F.col("assignment_id") == assignment_id)
        return cohort.select("file_id").distinct().join(self.of(assignment_id), "file_id", "left")

    def files_with(self, assignment_id: str, label: int) -> DataFrame:
        return self.of(assignment_id).filter(F.col("label") == int(label)).select("file_id")

    def unassigned(self, assignment_id: str) -> DataFrame:
        return self.label_map(assignment_id).filter("label IS NULL").select("file_id")

    def settled(self) -> Assignments:
        return Assignments(settle(self.labels), settle(self.cohort), self.runs)
