"""Session settings, lineage cuts and joins that hold up under skew and growth."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS_KEY = "spark.arborlake.salts"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "arborlake", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_root: list[str] = []
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a local session may use its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="run-arborlake-"))
    return _local_root[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    path = f"{shared_folder(spark)}/arborlake-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every folder made by ``scratch_path``; frames read from them can no longer be used."""
    while _made:
        _delete(spark, _made.pop())


def settle(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write the frame once to the shared folder and read on from there.

    A written table survives lost executors and gives later joins its true size. A checkpointed frame would keep
    the estimated size of its plan, which in a loop of joins is squared every round until planning takes longer
    than the work. ``replaces`` is an earlier settled frame that is no longer needed.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    if replaces is not None:
        forget(replaces)
    return out


def forget(df: DataFrame) -> None:
    """Delete the folder of a settled frame."""
    path = df.__dict__.get("_settled_path")
    if path:
        _delete(df.sparkSession, path)
        _made.remove(path)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Count rows and bytes of at most ``rows + 1`` rows and compare them with the bounds."""
    width = F.lit(0).cast("long")
    for name in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + F.lit(16)
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= size


def salts(spark: SparkSession) -> int:
    return int(spark.conf.get(SALTS_KEY, "16"))


#: Keys that a frequency summary names at most, items it tracks, and the share of an average task from which a key is heavy.
HEAVY_KEYS = 256
TRACKED_KEYS = 8192
HEAVY_SHARE = 0.5


def heavy_keys(rows: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that own so many rows that a task would feel it, from one bounded summary of frequent items.

    The summary is a sketch per task, merged like any aggregate. It only decides which rows are spread, so its errors
    cost time and change no result.
    """
    hashed = rows.select(F.xxhash64(*keys).alias("_key"))
    found = hashed.agg(F.expr(f"approx_top_k(_key, {HEAVY_KEYS}, {TRACKED_KEYS})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = HEAVY_SHARE * found["n"] / parts
    return [r["item"] for r in found["top"] or [] if r["item"] is not None and r["count"] > max(least, 1)]


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    salt_by: Sequence[str] | None = None,
    check: bool = True,
    summary: DataFrame | None = None,
    salt_all: bool | None = None,
) -> DataFrame:
    """Join many rows to a table with one row per key, whatever the key distribution.

    A table whose counted size is within the bound is broadcast, so ``big`` is not moved. Beyond it the heavy keys of ``big`` are
    named by a bounded summary (of ``summary``, a cheaper frame with the same keys, where one is given); their rows are hashed on
    (key, salt) and their rows of the table repeated once per salt, and all other rows meet in a plain join. So a key that owns a
    third of the rows is spread over many tasks and the table moves once. ``check=False`` is for a table that is itself an
    aggregate of the data (counting it first would run the aggregate twice); it then salts all keys, unless ``salt_all`` says
    otherwise. Every row of ``big`` meets exactly one copy of its key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if check and fits_broadcast(table):
        return big.join(F.broadcast(table), keys, how)
    n = salts(big.sparkSession)
    by: list[Column] = [F.col(c) for c in (salt_by or big.columns)]
    salt = F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    copies = F.sequence(F.lit(0), F.lit(n - 1))
    if not (not check if salt_all is None else salt_all):
        heavy = heavy_keys(big if summary is None else summary, keys)
        if not heavy:
            return big.join(table, keys, how)
        is_heavy = F.xxhash64(*keys).isin(heavy)
        salt, copies = F.when(is_heavy, salt).otherwise(0), F.when(is_heavy, copies).otherwise(F.array(F.lit(0)))
    salted = big.withColumn("_salt", salt)
    return salted.join(table.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how).drop("_salt")


def frame_of(spark: SparkSession, values: Sequence, name: str, kind: str) -> DataFrame:
    """A one-column table from a caller's list, sent as literals so Spark knows its size."""
    return spark.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{name} {kind}")


def keep_keys(df: DataFrame, values, name: str = "file_id", kind: str = "string", keep: bool = True) -> DataFrame:
    """Keep (or drop) rows by a caller's list or one-column frame; short lists reach the scan as IN.

    Dropping keeps rows whose key is null.
    """
    key = F.col(name).cast(kind)
    if isinstance(values, DataFrame):
        ids = values.select(F.col(values.columns[0]).cast(kind).alias("_key")).distinct()
    else:
        listed = list(dict.fromkeys(values))
        if kind == "string":
            listed = [str(v) for v in listed]
        if len(listed) <= 1000:
            hit = key.isin(listed) if listed else F.lit(False)
            return df.filter(hit if keep else (key.isNull() | ~hit))
        ids = frame_of(df.sparkSession, listed, "_key", kind)
    rows = df.withColumn("_key", key)
    return lookup_join(rows, ids, "_key", "left_semi" if keep else "left_anti").drop("_key")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
