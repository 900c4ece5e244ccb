"""Column expressions: naming, labels, keys and bins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..model import NODE_TYPE_LABELS, ORIGIN_MISSING, col

# Fixed patterns of the two file-name conventions.
PLAIN_NAME = r"^(\d+)_(\d+)_"
DOTTED_NAME = r"^(H\d+(?:\.\d+){6})_(\d+)"


def file_metadata(field: str) -> Column:
    """``file_name`` or ``file_path`` of a row's file as it is on disk; Spark gives both percent-encoded."""
    return F.url_decode(F.replace(F.col(f"_metadata.{field}"), F.lit("+"), F.lit("%2B")))


def file_stem(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"\.[^.]*$", "")


def subject_of(name: Column | str) -> Column:
    stem = file_stem(name)
    return (
        F.when(stem.rlike(PLAIN_NAME), F.regexp_extract(stem, PLAIN_NAME, 2))
        .when(stem.rlike(DOTTED_NAME), F.regexp_extract(stem, DOTTED_NAME, 1))
        .otherwise(stem)
    )


def neuron_of(name: Column | str) -> Column:
    stem = file_stem(name)
    return (
        F.when(stem.rlike(PLAIN_NAME), F.regexp_extract(stem, PLAIN_NAME, 1))
        .when(stem.rlike(DOTTED_NAME), F.regexp_extract(stem, DOTTED_NAME, 2))
        .otherwise(stem)
    )


def node_type_label(code: Column | str) -> Column:
    code = col(code)
    label = F.concat(F.lit("Type "), code.cast("string"))
    for value, text in reversed(NODE_TYPE_LABELS.items()):
        label = F.when(code == value, F.lit(text)).otherwise(label)
    return label


def region_name_form(name: Column | str) -> Column:
    """Lower case, slashes as commas, single spaces, no blanks or commas at the ends."""
    text = F.regexp_replace(F.lower(col(name)), "/", ", ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(text, r"^[ ,]+|[ ,]+$", "")


def origin_form(origin: Column | str) -> Column:
    text = F.trim(col(origin).cast("string"))
    return F.when(text.isNull() | (text == ""), F.lit(ORIGIN_MISSING)).otherwise(text)


def natural_key(label: Column | str) -> Column:
    """Sort key: digit runs by value, other runs case-folded; text before it breaks ties."""
    parts = F.regexp_extract_all(F.coalesce(col(label), F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(p.rlike(r"^\d"), F.lit(0)).otherwise(F.lit(1)).alias("is_text"),
            F.when(p.rlike(r"^\d"), F.length(F.regexp_replace(p, r"^0+(?=\d)", ""))).otherwise(0).alias("digits"),
            F.when(p.rlike(r"^\d"), F.regexp_replace(p, r"^0+(?=\d)", "")).otherwise(F.lower(p)).alias("body"),
        ),
    )


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low).cast("long")), F.lit(high).cast("long"))


def side_of(coordinate: Column | str, midline: float, tolerance: float) -> Column:
    """midline strictly inside the tolerance, otherwise left below and right above."""
    value = col(coordinate)
    return (
        F.when(F.abs(value - F.lit(float(midline))) < F.lit(float(tolerance)), F.lit("midline"))
        .when(value < F.lit(float(midline)), F.lit("left"))
        .otherwise(F.lit("right"))
    )


def path_ids(path: Column | str, kind: str) -> Column:
    """Ids of a structure path given as '/1/5/10/' text or as an array."""
    path = col(path)
    if kind.startswith("array"):
        return F.transform(path, lambda v: v.cast("int"))
    return F.transform(F.filter(F.split(path, "/"), lambda v: F.trim(v) != ""), lambda v: F.trim(v).cast("int"))
