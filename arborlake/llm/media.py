"""Images derived from vectors, since the tables hold none: a picture per vector, and edited copies of some of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import parts_for

SIDE = 96
BATCH = 128
#: Rows of a task: drawing takes far longer than its small input suggests to Spark.
TASK_ROWS = 1000
EDITS = ("crop", "crop_bright", "noise", "quarter_turn", "contrast")


def _waves(n: int) -> np.ndarray:
    """(n, SIDE * SIDE) plane waves of 4 to 20 cycles in all directions, the same in every run."""
    draw = np.random.RandomState(11)
    cycles, way, phase = draw.uniform(4, 20, n), draw.uniform(0, 2 * np.pi, n), draw.uniform(0, 2 * np.pi, n)
    y, x = np.mgrid[0:SIDE, 0:SIDE] / SIDE
    return np.stack([np.cos(2 * np.pi * c * (x * np.cos(w) + y * np.sin(w)) + p).ravel() for c, w, p in zip(cycles, way, phase)])


def picture(vectors: np.ndarray, waves: np.ndarray) -> np.ndarray:
    mixed = vectors @ waves
    spread = np.maximum(mixed.std(axis=1, keepdims=True), 1e-9)
    return np.clip(128 + 50 * mixed / spread, 0, 255).reshape(-1, SIDE, SIDE)


def edited(image: np.ndarray, edit: str, seed: int) -> np.ndarray:
    if edit == "crop":
        return image[10:82, 6:84]
    if edit == "crop_bright":
        return np.clip(image[4:80, 14:92] * 1.1 + 12, 0, 255)
    if edit == "noise":
        return np.clip(image + np.random.RandomState(seed).normal(0, 4, image.shape), 0, 255)
    if edit == "quarter_turn":
        return np.rot90(image)
    return 128 + 0.6 * (image - 128)


def pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.rint(image).astype(np.uint8).tobytes()


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waves: dict[int, np.ndarray] = {}
    for whole in batches:
        for at in range(0, len(whole), BATCH):
            batch = whole.slice(at, BATCH)
            vectors = batch.column("vector").to_pylist()
            images: list[bytes | None] = [None] * len(vectors)
            for n in {len(v) for v in vectors if v}:
                if n not in waves:
                    waves[n] = _waves(n)
                rows = [k for k, v in enumerate(vectors) if v and len(v) == n]
                drawn = picture(np.nan_to_num(np.array([vectors[k] for k in rows], float)), waves[n])
                for k, image in zip(rows, drawn):
                    edit = batch.column("edit")[k].as_py()
                    images[k] = pgm(edited(image, edit, (batch.column("image_id")[k].as_py() or 0) % (1 << 32)) if edit else image)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(images, pa.binary()), batch.column("edit")], ["image_id", "image", "edit"])


def vector_images(vectors: DataFrame) -> DataFrame:
    """(image_id, image, edit): the picture of every vector as a PGM; every fifth row shows an edit of the row three before."""
    own = vectors.select("vec_id", "embedding")
    copy = F.pmod("vec_id", F.lit(5)) == 3
    source = own.select(F.col("vec_id").alias("from"), F.col("embedding").alias("shown"))
    rows = own.withColumn("from", F.when(copy, F.col("vec_id") - 3)).join(source, "from", "left")
    number = F.pmod(F.xxhash64("vec_id"), F.lit(len(EDITS))).cast("int") + 1
    edit = F.when(F.col("shown").isNotNull(), F.element_at(F.array(*[F.lit(e) for e in EDITS]), number))
    rows = rows.select(F.col("vec_id").alias("image_id"), F.coalesce("shown", "embedding").alias("vector"), edit.alias("edit"))
    parts = parts_for(vectors.sparkSession, vectors.count(), TASK_ROWS)
    return rows.repartition(parts, "image_id").mapInArrow(_draw, "image_id long, image binary, edit string")
