"""Point tables from CSV and Parquet, and appending to them."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import file_metadata, origin_form
from ..model import ORIGIN_MISSING, POINT_OPTIONAL, POINT_REQUIRED
from ..session import lookup_join, settle

#: Column that carries the name of a row's file until it becomes the row's origin.
FILE = "_file"
STANDARD = (*POINT_REQUIRED, *POINT_OPTIONAL)

# Fixed values of the two-row header format: standard column -> flattened source column, and columns it must have.
TWO_ROW_MAPPING = {
    "label": "marker", "x": "atlas_x", "y": "atlas_y", "z": "atlas_z", "region_name": "region_name",
    "acronym": "region_acronym", "id": "region_id", "hemisphere": "region_hemisphere",
}
TWO_ROW_EXTRAS = ("experiment_x", "experiment_y", "experiment_z", "strength", "channel_mono_channel")


class PointFormatError(ValueError):
    """A point file or mapping that cannot be read as points."""


def check_mapping(mapping: Mapping[str, str]) -> dict[str, str]:
    """Target → source names: known targets, required ones present, no source used twice."""
    unknown = sorted(set(mapping) - set(STANDARD))
    if unknown:
        raise PointFormatError(f"unknown mapping targets {unknown}")
    if any(not isinstance(v, str) or not v.strip() for v in mapping.values()):
        raise PointFormatError("every mapping needs a source column name")
    clean = {k: v.strip() for k, v in mapping.items()}
    missing = [c for c in POINT_REQUIRED if c not in clean]
    if missing:
        raise PointFormatError(f"missing mappings {missing}")
    if len(set(clean.values())) != len(clean):
        raise PointFormatError("a source column is mapped twice")
    return clean


def load_mapping(spark: SparkSession, path: str) -> dict[str, str]:
    rows = spark.read.option("wholetext", "true").text(path).limit(1).collect()
    try:
        data = json.loads(rows[0][0])
    except (IndexError, json.JSONDecodeError) as error:
        raise PointFormatError(f"mapping file {path} is not JSON") from error
    if not isinstance(data, dict):
        raise PointFormatError("the mapping file must hold one object")
    return check_mapping(data)


def apply_mapping(raw: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename mapped sources, add missing optional columns, keep the rest as extras."""
    mapping = check_mapping(mapping)
    missing = sorted(set(mapping.values()) - set(raw.columns))
    if missing:
        raise PointFormatError(f"mapped source columns not found {missing}")
    extras = [c for c in raw.columns if c not in mapping.values()]
    clash = [c for c in extras if c in STANDARD]
    if clash:
        raise PointFormatError(f"unmapped columns clash with standard names {clash}")
    return raw.select(*[F.col(f"`{source}`").alias(target) for target, source in mapping.items()], *[F.col(f"`{c}`") for c in extras])


def _number(name: str) -> Column:
    return F.expr(f"try_cast(trim(CAST(`{name}` AS STRING)) AS DOUBLE)")


def row_faults(points: DataFrame) -> Column:
    """Names of the columns whose value breaks a rule: blank label, coordinate or integer id that is none."""
    def unless(bad: Column, name: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))

    faults = [unless(F.trim(F.col("label").cast("string")) == "", "label")]
    faults += [unless(_number(c).isNull() | F.isnan(_number(c)), c) for c in "xyz"]
    if "id" in points.columns:
        given = F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) != ""
        whole = (_number("id") == F.floor(_number("id"))) & (F.abs(_number("id")) < float(1 << 62))
        faults.append(F.when(given & ~F.coalesce(whole, F.lit(False)), F.lit("id")))
    return F.array_compact(F.array(*faults))


def validate_points(points: DataFrame, check: bool = True) -> DataFrame:
    """Standard types and order: text label, double coordinates, optional columns, integer id, extras last.

    With ``check`` one aggregate counts the violations and raises; without it the caller trusts the rows.
    """
    missing = [c for c in POINT_REQUIRED if c not in points.columns]
    if missing:
        raise PointFormatError(f"missing point columns {missing}")
    if check:
        tested = points.select(row_faults(points).alias("faults"))
        row = tested.agg(*[F.count_if(F.array_contains("faults", c)).alias(c) for c in ("label", "x", "y", "z", "id")]).first().asDict()
        broken = {k: v for k, v in row.items() if v}
        if broken:
            raise PointFormatError(f"invalid values per column: {broken}")
    text = lambda c: F.col(c).cast("string") if c in points.columns else F.lit(None).cast("string")
    number = _number("id") if "id" in points.columns else F.lit(None).cast("double")
    extras = [c for c in points.columns if c not in STANDARD]
    return points.select(
        F.trim(F.col("label").cast("string")).alias("label"), *[_number(c).alias(c) for c in "xyz"], text("region_name").alias("region_name"),
        text("acronym").alias("acronym"), number.cast("long").alias("id"), text("hemisphere").alias("hemisphere"),
        *[F.col(f"`{c}`") for c in extras],
    )


# -- CSV files, each under its own header ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How files that share their first lines are read: ``kind`` and the names of their columns."""

    kind: str
    names: tuple[str, ...]
    skipped: tuple[str, ...]


def _heads(batches):
    """The first two lines of every file; the rows are those of the files' first blocks, in order."""
    current, seen = None, 0
    for batch in batches:
        paths = batch.column("path").to_pylist()
        keep = []
        for k, path in enumerate(paths):
            if path != current:
                current, seen = path, 0
            if seen < 2:
                keep.append(k)
            seen += 1
        yield batch.take(pa.array(keep, pa.int64()))


def file_heads(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, lines): the first two lines of every file that has any, in one pass."""
    lines = spark.read.text(path).select(file_metadata("file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("block"))
    first = lines.filter("block = 0").select("path", "value").mapInArrow(_heads, "path string, value string")
    numbered = first.select("path", F.struct(F.monotonically_increasing_id().alias("n"), "value").alias("line"))
    return numbered.groupBy("path").agg(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"]).alias("lines"))


def _words(cell: str) -> str:
    return "_".join(re.findall("[0-9A-Za-z]+", cell)).lower()


def _two_row_name(group: str, part: str) -> str:
    """A column is called after its group and its own cell; markers, channels and the strength have no group in their name."""
    if group == "marker":
        return group
    alone = group in ("", "channels") or (group, part) == ("experiment", "strength")
    return part if alone else "_".join(filter(None, (group, part)))


def flatten_header(top: Sequence[str], sub: Sequence[str]) -> list[str]:
    """One name per column of a two-row header; a blank group cell belongs to the group on its left."""
    cells = [(_words(a), _words(b)) for a, b in zip_longest(top, sub, fillvalue="")]
    groups = accumulate((a for a, _ in cells), lambda group, cell: cell or group)
    names = [_two_row_name(group, part) for group, (_, part) in zip(groups, cells)]
    if not all(names):
        raise PointFormatError("a column of the two-row header has no name")
    return names


def layout_of(lines: Sequence[str], mapping: Mapping[str, str] | None = None) -> Layout:
    """What a file's first lines say: the mapping's columns, the standard ones, or a two-row header."""
    rows = list(csv.reader(lines[:2]))
    names = [c.strip().lstrip("\ufeff") for c in rows[0]] if rows else []
    kind = "mapping" if mapping is not None else "standard"
    wanted = set(check_mapping(mapping).values()) if mapping is not None else set(POINT_REQUIRED)
    skipped = tuple(lines[:1])
    if not wanted <= set(names):
        flat = flatten_header(*rows) if mapping is None and len(rows) == 2 else []
        lacking = sorted((set(TWO_ROW_MAPPING.values()) | set(TWO_ROW_EXTRAS)) - set(flat))
        if mapping is not None:
            raise PointFormatError(f"mapped source columns not found {sorted(wanted - set(names))}")
        if not set(TWO_ROW_MAPPING.values()) <= set(flat):
            raise PointFormatError("point columns cannot be inferred: give a mapping")
        if lacking:
            raise PointFormatError(f"two-row file lacks columns {lacking}")
        kind, names, skipped = "two-row", flat, tuple(lines[:2])
    if len({n.lower() for n in names}) < len(names) or "" in names:
        raise PointFormatError("a column of the header is blank or named twice")
    return Layout(kind, tuple(names), skipped)


LAYOUTS = "path string, kind string, names array<string>, skipped array<string>, reason string"


def _classified(mapping: Mapping[str, str] | None):
    def run(batches):
        for batch in batches:
            out = []
            for path, lines in zip(batch.column("path").to_pylist(), batch.column("lines").to_pylist()):
                try:
                    layout = layout_of(lines, mapping)
                    out.append((path, layout.kind, list(layout.names), list(layout.skipped), None))
                except PointFormatError as error:
                    out.append((path, None, None, None, str(error)))
            text, lists = pa.string(), pa.list_(pa.string())
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (text, text, lists, lists, text))], ["path", "kind", "names", "skipped", "reason"])

    return run


def file_layouts(spark: SparkSession, path: str | Sequence[str], mapping: Mapping[str, str] | None = None) -> DataFrame:
    """(path, kind, names, skipped, reason): the layout of every file, or the reason why it has none. A table, however many files there are."""
    if mapping is not None:
        check_mapping(mapping)
    return settle(file_heads(spark, path).mapInArrow(_classified(mapping), LAYOUTS))


def _read_layout(lines: DataFrame, layout: Layout, mapping: Mapping[str, str] | None) -> DataFrame:
    """Rows of the lines under the standard names, every column as text, with the file's name."""
    plain = [f"c{k}" for k in range(len(layout.names))]
    cells = F.from_csv("value", F.lit(", ".join(f"{c} STRING" for c in plain)))
    parsed = lines.select(cells.alias("_cells"), FILE)
    named = parsed.select(*[F.col("_cells").getField(c).alias(n) for c, n in zip(plain, layout.names)], FILE)
    mapping = TWO_ROW_MAPPING if layout.kind == "two-row" else mapping
    return apply_mapping(named, mapping) if mapping is not None else named


def read_point_files(spark: SparkSession, path: str | Sequence[str], mapping: Mapping[str, str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Rows of all readable files, each read under its own header, and (path, reason) of the others.

    Lines meet their file's layout in a join; only the distinct layouts, as many as there are kinds of headers, come to the
    driver. Blank lines and lines that are a header line again are no points.
    """
    layouts = file_layouts(spark, path, mapping)
    refused = layouts.filter("reason IS NOT NULL").select("path", "reason")
    kinds = layouts.filter("reason IS NULL").groupBy("kind", "names", "skipped").agg(F.min("path").alias("first")).orderBy("first").collect()
    if not kinds:
        return None, refused
    lines = spark.read.text(path).select(file_metadata("file_path").alias("path"), file_metadata("file_name").alias(FILE), "value")
    known = layouts.filter("reason IS NULL").select("path", "kind", "names", "skipped")
    lines = lookup_join(lines.filter(F.trim("value") != ""), known, "path", salt_by=["value"]).filter(~F.array_contains("skipped", F.col("value")))
    frames = []
    for row in kinds:
        layout = Layout(row["kind"], tuple(row["names"]), tuple(row["skipped"]))
        mine = (F.col("kind") == layout.kind) & (F.col("names") == F.array(*[F.lit(n) for n in layout.names])) & (F.col("skipped") == F.array(*[F.lit(n) for n in layout.skipped]))
        frames.append(_read_layout(lines.filter(mine), layout, mapping))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), refused


def infer_points_format(spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None) -> str:
    """The kinds of all files of the path, comma-separated; an unreadable file is an error that names it."""
    layouts = file_layouts(spark, path, mapping)
    _refuse(layouts.filter("reason IS NOT NULL"))
    return ",".join(sorted(r[0] for r in layouts.select("kind").distinct().collect()))


#: Files that an error names.
NAMED = 20


def _refuse(refused: DataFrame) -> None:
    found = refused.select("path", "reason").orderBy("path").limit(NAMED + 1).collect()
    if found:
        more = "; and more" if len(found) > NAMED else ""
        raise PointFormatError("; ".join(f"{path}: {reason}" for path, reason in found[:NAMED]) + more)


def read_points_csv(spark: SparkSession, path: str | Sequence[str], mapping: Mapping[str, str] | None = None, check: bool = True) -> DataFrame:
    """Standard points of all files, with the file name as ``origin_csv`` where the file has none.

    Each file is read under its own header: columns may come in any order, some files may have extra columns, and
    standard and two-row headers may stand side by side. A file without a known header is an error that names it.
    """
    points, refused = read_point_files(spark, path, mapping)
    _refuse(refused)
    if points is None:
        raise PointFormatError("no point file has a header")
    return with_origin(validate_points(points, check), F.col(FILE)).drop(FILE)


def with_origin(points: DataFrame, default: Column | str) -> DataFrame:
    """Fill a missing or blank ``origin_csv``."""
    value = F.lit(default) if isinstance(default, str) else default
    if "origin_csv" not in points.columns:
        return points.withColumn("origin_csv", value)
    text = F.trim(F.col("origin_csv").cast("string"))
    return points.withColumn("origin_csv", F.when(text.isNull() | (text == ""), value).otherwise(text))


def read_points_parquet(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    points = spark.read.parquet(path)
    missing = [c for c in POINT_REQUIRED if c not in points.columns]
    if missing:
        raise PointFormatError(f"missing point columns {missing}")
    return validate_points(points, check)


def check_append_schema(incoming: DataFrame, target: DataFrame) -> None:
    """Same names, order and types."""
    mine, theirs = incoming.columns, target.columns
    if mine != theirs:
        missing, extra = [c for c in theirs if c not in mine], [c for c in mine if c not in theirs]
        what = f"missing {missing}" if missing else f"extra {extra}" if extra else "column order differs"
        raise PointFormatError(f"point schema mismatch: {what}")
    for (name, a), (_, b) in zip(incoming.dtypes, target.dtypes):
        if a != b:
            raise PointFormatError(f"point schema mismatch: {name} is {a}, the table has {b}")


def appended_points(existing: DataFrame, incoming: DataFrame, default_origin: str = ORIGIN_MISSING) -> DataFrame:
    """Existing and incoming rows under the existing schema; rows without an origin are marked as not recorded."""
    if "origin_csv" in incoming.columns and "origin_csv" not in existing.columns:
        existing = existing.withColumn("origin_csv", F.lit(ORIGIN_MISSING))
    if "origin_csv" in existing.columns:
        incoming = with_origin(incoming, default_origin)
    check_append_schema(incoming, existing)
    return existing.unionByName(incoming)


def append_points(spark: SparkSession, path: str, incoming: DataFrame, output: str | None = None) -> None:
    """Append to a point table. Without a new column the files are added; otherwise a new table is written."""
    existing = spark.read.parquet(path)
    rows = appended_points(existing, incoming)
    if output is not None:
        rows.write.parquet(output)
    elif rows.columns == existing.columns:
        with_origin(incoming, ORIGIN_MISSING).select(*existing.columns).write.mode("append").parquet(path)
    else:
        raise PointFormatError("the table gains origin_csv: name an output folder")


def convert_points_dir(spark: SparkSession, folder: str, output: str, mapping: Mapping[str, str] | None = None, mode: str = "error") -> None:
    """All CSV files of a folder as one point table with their file names."""
    read_points_csv(spark, folder, mapping).write.mode(mode).parquet(output)


def origins(points: DataFrame) -> DataFrame:
    return points.select(origin_form("origin_csv").alias("origin_csv")).distinct().orderBy("origin_csv")
