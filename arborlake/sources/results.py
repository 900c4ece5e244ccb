"""Search results, annotations, grid descriptions and exports of clusterings."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import SOMA, finite
from ..operators.clustering import Tree
from ..operators.sets import Assignments
from ..session import keep_keys, lookup_join

# Fixed values of the search result file.
FORMAT_VERSION = 2
REFERENCE, RESULT = "reference", "search_result"
SEARCH_COLUMNS = ("format_version", "row_role", "rank", "file_id", "neuron_id", "subject", "pearson_distance", "search_context_json")


def search_rows(references: DataFrame, hits: DataFrame, context: Mapping | str) -> DataFrame:
    """References with rank 0 and no distance, then the hits; the context is repeated per row."""
    text = context if isinstance(context, str) else json.dumps(context, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    blank = lambda df, c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    def rows(df: DataFrame, role: str, rank: Column, distance: Column) -> DataFrame:
        return df.select(
            F.lit(FORMAT_VERSION).alias("format_version"), F.lit(role).alias("row_role"), rank.cast("long").alias("rank"),
            F.col("file_id").cast("string").alias("file_id"), blank(df, "neuron_id").alias("neuron_id"), blank(df, "subject").alias("subject"),
            distance.cast("double").alias("pearson_distance"), F.lit(text).alias("search_context_json"),
        )
    both = rows(references, REFERENCE, F.lit(0), F.lit(None)).unionByName(rows(hits, RESULT, F.col("rank"), F.col("pearson_distance")))
    return both.select(*SEARCH_COLUMNS)


def write_search_csv(references: DataFrame, hits: DataFrame, context: Mapping | str, path: str, mode: str = "error") -> None:
    """Validated result rows as CSV, in rank order."""
    rows = search_rows(references, hits, context)
    problems = search_problems(rows)
    if problems:
        raise ValueError("; ".join(problems))
    rows.orderBy("rank", "file_id").write.mode(mode).option("header", "true").csv(path, quoteAll=True, escape='"')


def _good_distance() -> Column:
    d = F.col("_distance")
    return F.coalesce(finite(d) & (d >= 0) & (d <= 2), F.lit(False))


def _typed(rows: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.expr("try_cast(format_version AS DOUBLE)").alias("_version"), text("row_role").alias("row_role"),
        F.expr("try_cast(rank AS DOUBLE)").alias("_rank") if "rank" in rows.columns else F.lit(None).cast("double").alias("_rank"),
        text("file_id").alias("file_id"), F.coalesce(text("neuron_id"), F.lit("")).alias("neuron_id"),
        F.coalesce(text("subject"), F.lit("")).alias("subject"), text("pearson_distance").alias("_raw"),
        F.expr("try_cast(pearson_distance AS DOUBLE)").alias("_distance"), text("search_context_json").alias("_context"),
    )


def search_problems(rows: DataFrame) -> list[str]:
    """What is wrong with a result table; all checks come from one aggregate and a grouped duplicate test."""
    missing = {"format_version", "file_id", "pearson_distance"} - set(rows.columns)
    if missing:
        return [f"missing columns {sorted(missing)}"]
    typed = _typed(rows)
    role = F.coalesce("row_role", F.lit(""))
    is_hit, is_ref = role == RESULT, role == REFERENCE
    context = F.col("_context")
    row = typed.agg(
        F.count(F.lit(1)).alias("n"), F.min("_version").alias("v0"), F.max("_version").alias("v1"),
        F.count_if(F.col("_version").isNull()).alias("bad_version"),
        F.count_if(F.col("file_id").isNull() | (F.trim("file_id") == "")).alias("empty_id"),
        F.count_if(~is_hit & ~is_ref).alias("bad_role"), F.count_if(is_hit).alias("hits"), F.count_if(is_ref).alias("refs"),
        F.count_if(is_ref & ~F.coalesce(F.col("_rank") == 0, F.lit(False))).alias("ref_rank"),
        F.count_if(is_ref & F.col("_raw").isNotNull() & (F.trim("_raw") != "")).alias("ref_distance"),
        F.count_if(is_hit & ~_good_distance()).alias("hit_distance"), F.count_if(~_good_distance()).alias("any_distance"),
        F.count_if(is_hit & (F.col("_rank").isNull() | (F.col("_rank") != F.floor("_rank")))).alias("rank_type"),
        F.min(F.when(is_hit, F.col("_rank"))).alias("rank_lo"), F.max(F.when(is_hit, F.col("_rank"))).alias("rank_hi"),
        F.count_distinct(F.when(is_hit, F.col("_rank"))).alias("ranks"),
        F.count_if(context.isNull() | (F.trim("_context") == "")).alias("no_context"), F.count_distinct("_context").alias("contexts"),
        F.count_if(context.isNotNull() & F.get_json_object("_context", "$").isNull()).alias("bad_context"),
    ).first()
    if not row["n"]:
        return ["no result rows"]
    if row["bad_version"] or row["v0"] != row["v1"] or row["v0"] not in (1.0, float(FORMAT_VERSION)):
        return ["one supported format version is needed"]
    problems = []
    if row["empty_id"]:
        problems.append("empty file_id")
    if typed.groupBy("file_id").count().filter("count > 1").limit(1).count():
        problems.append("duplicate file_id")
    if row["v0"] == 1.0:
        return problems + (["distances must lie in [0, 2]"] if row["any_distance"] else [])
    tests = {
        "unknown row_role": row["bad_role"], "no reference row": not row["refs"], "no result row": not row["hits"],
        "references need rank 0": row["ref_rank"], "references must have no distance": row["ref_distance"],
        "distances must lie in [0, 2]": row["hit_distance"], "ranks must be integers": row["rank_type"],
        "ranks must be contiguous from 1": row["hits"] and (row["rank_lo"] != 1 or row["rank_hi"] != row["hits"] or row["ranks"] != row["hits"]),
        "context JSON missing": row["no_context"], "context JSON invalid": row["bad_context"], "conflicting context": row["contexts"] > 1,
    }
    return problems + [name for name, broken in tests.items() if broken]


def read_search_csv(spark: SparkSession, path: str, catalog: DataFrame | None = None) -> DataFrame:
    """Validated rows (row_role, rank, file_id, neuron_id, subject, pearson_distance, available).

    A version 1 file has no roles or ranks: its rows are ranked by distance, then file_id.
    """
    from ..functions.ranks import number_rows

    rows = spark.read.option("header", "true").option("escape", '"').csv(path)
    problems = search_problems(rows)
    if problems:
        raise ValueError("; ".join(problems))
    typed = _typed(rows)
    if typed.select("_version").first()[0] == 1.0:
        ranked = number_rows(typed.select("file_id", "neuron_id", "subject", F.col("_distance").alias("pearson_distance")), ["pearson_distance", "file_id"], "rank", 1)
        out = ranked.withColumn("row_role", F.lit(RESULT))
    else:
        out = typed.select("row_role", F.col("_rank").cast("long").alias("rank"), "file_id", "neuron_id", "subject", F.col("_distance").alias("pearson_distance"))
    names = ["row_role", "rank", "file_id", "neuron_id", "subject", "pearson_distance"]
    if catalog is None:
        return out.select(*names, F.lit(True).alias("available"))
    known = catalog.select(F.col("file_id").cast("string").alias("file_id"), F.lit(True).alias("available")).distinct()
    return out.join(known, "file_id", "left").select(*names, F.coalesce("available", F.lit(False)).alias("available"))


# --- annotations

ANNOTATION_COLUMNS = ("neuron_label", "neuron_group", "neuron_tags_json", "neuron_notes", "cluster_assignment")


def decode_tags(text: Column | str) -> Column:
    """Tags from JSON text; text that is not JSON is kept as one tag, JSON that is not a list gives none."""
    text = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<string>")
    listed = F.from_json(text, "array<string>")
    return (
        F.when(text.isNull() | (text == ""), none).when(text.rlike(r"^\s*\[") & listed.isNotNull(), listed)
        .when(F.get_json_object(text, "$").isNotNull(), none).otherwise(F.array(text))
    )


def read_annotations(nodes: DataFrame) -> DataFrame:
    """One row per file from the annotation columns of a node table; the largest value stands for the file."""
    top = lambda c: F.max(F.col(c).cast("string")) if c in nodes.columns else F.lit(None).cast("string")
    cluster = next((c for c in ("cluster_assignment", "cluster_id") if c in nodes.columns), None)
    rows = nodes.groupBy(F.col("file_id").cast("string").alias("file_id")).agg(
        F.coalesce(top("subject"), F.lit("")).alias("subject"), F.coalesce(top("neuron_label"), F.lit("")).alias("label"),
        F.coalesce(top("neuron_group"), F.lit("")).alias("group"), top("neuron_tags_json").alias("_tags"),
        F.coalesce(top("neuron_notes"), F.lit("")).alias("notes"),
        (F.max(F.col(cluster).cast("int")) if cluster else F.lit(None).cast("int")).alias("cluster_id"),
    )
    return rows.select("file_id", "subject", "label", "group", decode_tags("_tags").alias("tags"), "notes", "cluster_id")


def attach_clusters(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes with ``cluster_assignment`` (null if unassigned), replaced if present."""
    table = labels.select(F.col("file_id").cast("string").alias("file_id"), F.col("label").cast("int").alias("cluster_assignment"))
    return lookup_join(nodes.drop("cluster_assignment"), table, "file_id", "left", salt_by=["node_id"])


def write_clustered_nodes(nodes: DataFrame, labels: DataFrame, path: str, mode: str = "error") -> None:
    attach_clusters(nodes, labels).write.mode(mode).option("compression", "snappy").parquet(path)


def annotation_columns(entries: DataFrame, runs: Assignments | None = None, active: str | None = None) -> DataFrame:
    """One row per file: the annotation columns and a label column per stored run."""
    has = lambda c: F.col(c) if c in entries.columns else F.lit(None).cast("string")
    tags = F.when(F.size("tags") > 0, F.to_json("tags")) if dict(entries.dtypes).get("tags", "").startswith("array") else has("tags")
    rows = entries.select(
        F.col("file_id").cast("string").alias("file_id"), has("label").alias("neuron_label"), has("group").alias("neuron_group"),
        tags.alias("neuron_tags_json"), has("notes").alias("neuron_notes"),
        (F.col("cluster_id") if "cluster_id" in entries.columns else F.lit(None)).cast("int").alias("cluster_assignment"),
    )
    if runs is None:
        return rows
    if active is not None:
        rows = rows.drop("cluster_assignment").join(runs.of(active).withColumnRenamed("label", "cluster_assignment"), "file_id", "left")
    ids = [r["assignment_id"] for r in runs.runs]
    wide = runs.labels.groupBy("file_id").pivot("assignment_id", ids).agg(F.max("label")) if ids else None
    if wide is not None:
        wide = wide.withColumnsRenamed({r["assignment_id"]: r["column_name"] for r in runs.runs})
        rows = rows.join(wide, "file_id", "left")
    return rows


def attach_annotations(nodes: DataFrame, entries: DataFrame, runs: Assignments | None = None, active: str | None = None) -> DataFrame:
    table = annotation_columns(entries, runs, active)
    owned = [c for c in table.columns if c != "file_id"]
    return lookup_join(nodes.drop(*owned), table, "file_id", "left", salt_by=["node_id"])


def write_annotated_nodes(nodes: DataFrame, entries: DataFrame, path: str, runs: Assignments | None = None, active: str | None = None, mode: str = "error") -> None:
    attach_annotations(nodes, entries, runs, active).write.mode(mode).option("compression", "snappy").parquet(path)


def cohort_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes of the chosen files with the rows' columns; ``row_order`` gives the order of files."""
    extra = [c for c in rows.columns if c != "file_id"]
    return lookup_join(nodes.drop(*extra), rows, "file_id", salt_by=["node_id"])


def write_cohort_nodes(nodes: DataFrame, rows: DataFrame, path: str, mode: str = "error") -> None:
    """Written in (row_order, file_id, node_id) order by ranges."""
    out = cohort_nodes(nodes, rows)
    if not rows.limit(1).count():
        raise ValueError("choose at least one neuron")
    order = ["row_order", "file_id", "node_id"]
    out.repartitionByRange(*order).sortWithinPartitions(*order).drop("row_order").write.mode(mode).option("compression", "snappy").parquet(path)


# --- clusterings

def cluster_table(nodes: DataFrame, tree: Tree, labels: DataFrame) -> DataFrame:
    """One row per clustered neuron in leaf order, from 1."""
    soma = lambda c: F.when(F.col("type") == SOMA, F.col(c))
    chosen = keep_keys(nodes, labels.select("file_id"))
    facts = chosen.groupBy("file_id").agg(
        F.max("neuron_id").alias("neuron_id"), F.max("subject").alias("subject"),
        *[F.avg(soma(c)).alias(f"soma_{c}_um") for c in "xyz"], F.max(soma("region_acronym")).alias("soma_region_acronym"),
    )
    rows = tree.leaf_order.join(labels, "file_id").join(facts, "file_id", "left")
    return rows.select(
        (F.col("position") + 1).alias("dendrogram_order"), "file_id", "neuron_id", "subject", F.col("label").alias("cluster_assignment"),
        "soma_x_um", "soma_y_um", "soma_z_um", "soma_region_acronym",
    ).orderBy("dendrogram_order")


def cluster_group(labels: DataFrame, label: int, name: str) -> DataFrame:
    """(name, cluster_label, file_id) of one cluster; a name and a member are needed."""
    rows = labels.filter(F.col("label") == int(label))
    if not name.strip() or not rows.limit(1).count():
        raise ValueError("choose a named, non-empty cluster")
    return rows.select(F.lit(name.strip()).alias("name"), F.lit(int(label)).alias("cluster_label"), "file_id")


def save_cluster_group(labels: DataFrame, label: int, name: str, path: str, mode: str = "error") -> None:
    cluster_group(labels, label, name).write.mode(mode).json(path)


# Columns of the projected node export, in order.
PROJECTED_COLUMNS = (
    "file_id", "neuron_id", "subject", "node_id", "parent_id", "type", "x_um", "y_um", "z_um", "voxel_i", "voxel_j", "voxel_k",
    "x_flat", "y_flat", "depth_um", "valid", "invalid_reason", "region_id", "region_acronym", "flatmap_style", "coordinate_mode",
    "flatmap_lookup_mode", "flatmap_valid", "depth_valid", "render_valid", "x_flat_bin", "y_flat_bin", "depth_bin",
    "depth_bin_label", "allen_layer_index", "allen_layer_label", "allen_layer_selected", "allen_layer_render_index",
)


def projected_rows(projected: DataFrame) -> DataFrame:
    """The export's columns; a missing one is empty, x, y, z become x_um, y_um, z_um."""
    rows = projected
    for c in "xyz":
        if c in rows.columns and f"{c}_um" not in rows.columns:
            rows = rows.withColumnRenamed(c, f"{c}_um")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in PROJECTED_COLUMNS])


def write_projected_csv(projected: DataFrame, path: str, mode: str = "error") -> None:
    projected_rows(projected).write.mode(mode).option("header", "true").csv(path)


# --- grid description

def write_grid_spec(spark: SparkSession, specs: Mapping[str, Mapping], path: str, mode: str = "error") -> None:
    """Bounds and sentinels per flatmap style as a small table beside the data."""
    rows = [(style, json.dumps(dict(spec), sort_keys=True)) for style, spec in sorted(specs.items())]
    spark.createDataFrame(rows, "style string, spec string").write.mode(mode).json(path)


def read_grid_spec(spark: SparkSession, path: str, style: str) -> dict | None:
    found = spark.read.schema("style string, spec string").json(path).filter(F.col("style") == style).limit(1).collect()
    return json.loads(found[0]["spec"]) if found else None


