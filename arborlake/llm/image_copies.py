"""Local image descriptors: cropped and edited copies of images, found by what their corners look like.

Every image is described by its strongest corners at several scales. A corner's patch is turned to the direction of its
brightness centre and ``BITS`` brightness comparisons inside it become a binary descriptor. A descriptor is cut into
``TABLES`` keys; corners of two images that share a key in the same table meet, and stay if few of all bits differ. Two
descriptors that differ in fewer than ``TABLES`` bits share a key for certain, others with a chance. For each pair of images the
matches vote on one similarity transform (turn, scale and shift); a pair is a copy if enough corners agree on it.

Images are described where they are read, so no image moves. Images of equal bytes are one class and are compared once.
Descriptors travel with their keys: a meeting is decided in the join itself, under the first key that two corners share, so only
matches become rows. Corners of a crowded key are dealt out by salt and the asking corners repeated, which keeps every meeting.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fits_broadcast, lookup_join, settle
from .common import bounded_batches

BITS = 256
TABLES = 4
#: Sides of the pyramid's levels and the corners kept on each.
LEVELS = ((1.0, 28), (0.7071, 12), (0.5, 6))
RADIUS = 8
MARGIN = RADIUS + 2
TURNS = 32
FAR = 40
LEAST = 5
#: Pixels by which a corner may miss the place that the transform gives it, on the first level.
SLACK = 4.0


# -- decoding --------------------------------------------------------------------------------------------------------


def _netpbm(data: bytes) -> np.ndarray:
    match = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not match or int(match[4]) != 255:
        raise ValueError("not an 8-bit PGM or PPM")
    w, h, deep = int(match[2]), int(match[3]), 1 if match[1] == b"5" else 3
    return np.frombuffer(data, np.uint8, w * h * deep, match.end()).reshape(h, w, deep)


def _png(data: bytes) -> np.ndarray:
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at:at + 4], "big"), data[at + 4:at + 8]
        body = data[at + 8:at + 8 + size]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if head is None or head[8] != 8 or head[9] not in (0, 2, 4, 6) or head[12]:
        raise ValueError("not a plain 8-bit PNG")
    w, h, deep = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), {0: 1, 2: 3, 4: 2, 6: 4}[head[9]]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * deep)
    out = np.zeros((h + 1, (w + 1) * deep), np.int64)  # a row above and a pixel before, both black
    for y, line in enumerate(lines):
        kind, raw, up, row = line[0], line[1:].astype(np.int64), out[y], out[y + 1]
        if kind == 0:
            row[deep:] = raw
        elif kind == 2:
            row[deep:] = (raw + up[deep:]) & 255
        else:
            for x in range(len(raw)):
                left, above, corner = row[x], up[x + deep], up[x]
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                row[x + deep] = (raw[x] + guess) & 255
    return out[1:, deep:].reshape(h, w, deep).astype(np.uint8)


def decode(data: bytes | None) -> np.ndarray | None:
    """Brightness of a PGM, PPM or 8-bit PNG image as floats; None for anything else."""
    try:
        pixels = _png(data) if data and data[:4] == b"\x89PNG" else _netpbm(data or b"")
    except (ValueError, zlib.error):
        return None
    pixels = pixels.astype(np.float32)
    return pixels[:, :, 0] if pixels.shape[2] < 3 else pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114], np.float32)


# -- corners and descriptors -----------------------------------------------------------------------------------------


def _tests() -> np.ndarray:
    """(turns, BITS, 2, 2): two points (x, y) of every comparison, for every turn of the patch. The same in every run."""
    draw = np.random.RandomState(5).standard_normal((BITS * 4, 2, 2)) * RADIUS / 2.2
    draw = draw[(np.hypot(draw[..., 0], draw[..., 1]) <= RADIUS - 0.5).all(axis=1)][:BITS]
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    return np.rint(np.einsum("ijt,bpj->tbpi", turn, draw)).astype(np.int64)


_POINTS = _tests()
_DISC = np.array([(x, y) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])


def _line(n: int, m: int) -> np.ndarray:
    """Matrix that resamples n values to m by linear interpolation."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    out = np.zeros((m, n), np.float32)
    out[np.arange(m), low] = 1 - (at - low)
    if n > 1:
        out[np.arange(m), low + 1] += at - low
    return out


def _smooth(a: np.ndarray) -> np.ndarray:
    """Binomial smoothing over 5 x 5, edges repeated."""
    pad = np.pad(a, 2, mode="edge")
    pad = (pad[:-4] + pad[4:] + 4 * (pad[1:-3] + pad[3:-1]) + 6 * pad[2:-2]) / 16
    return (pad[:, :-4] + pad[:, 4:] + 4 * (pad[:, 1:-3] + pad[:, 3:-1]) + 6 * pad[:, 2:-2]) / 16


def _corners(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the strongest corners: peaks over 5 x 5 of det - 0.04 trace^2 of the smoothed gradient products."""
    gy, gx = np.gradient(a)
    xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
    strength = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    around = np.maximum.reduce([strength[k:len(strength) - 4 + k] for k in range(5)])
    around = np.maximum.reduce([around[:, k:around.shape[1] - 4 + k] for k in range(5)])
    inner = strength[MARGIN:-MARGIN, MARGIN:-MARGIN]
    rim = MARGIN - 2
    y, x = np.nonzero((inner >= around[rim:-rim, rim:-rim]) & (inner > max(1.0, 1e-4 * float(strength.max()))))
    best = np.lexsort((x, y, -inner[y, x]))[:most]
    return x[best] + MARGIN, y[best] + MARGIN


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) floats x, y, scale, angle in the image's own pixels, and (n, 4) descriptors of 64 bits each."""
    places, bits = [], []
    for scale, most in LEVELS if image is not None else ():
        h, w = (max(1, round(s * scale)) for s in image.shape)
        if min(h, w) <= 2 * MARGIN + 1:
            continue
        a = _smooth(_line(image.shape[0], h) @ image @ _line(image.shape[1], w).T)
        x, y = _corners(a, most)
        patch = a[y[:, None] + _DISC[:, 1], x[:, None] + _DISC[:, 0]]
        angle = np.arctan2((patch * _DISC[:, 1]).sum(axis=1), (patch * _DISC[:, 0]).sum(axis=1))
        points = _POINTS[np.rint(angle * TURNS / (2 * np.pi)).astype(int) % TURNS]
        values = a[y[:, None, None] + points[..., 1], x[:, None, None] + points[..., 0]]
        bits.append(values[..., 0] < values[..., 1])
        places.append(np.stack([(x + 0.5) * image.shape[1] / w, (y + 0.5) * image.shape[0] / h, np.full(len(x), 1 / scale), angle], axis=1))
    if not places:
        return np.zeros((0, 4)), np.zeros((0, 4), np.int64)
    return np.concatenate(places), np.packbits(np.concatenate(bits), axis=1, bitorder="little").view("<i8")


FEATURES = "array<struct<corner:int,x:float,y:float,scale:float,angle:float,d0:long,d1:long,d2:long,d3:long>>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images = batch.column("image").to_pylist()
        digests = [None if image is None else hashlib.sha256(image).hexdigest() for image in images]
        known = {d: describe(decode(image)) for d, image in zip(digests, images)}
        found = [known[d] for d in digests]
        counts = np.array([len(p) for p, _ in found], int)
        places = np.concatenate([p for p, _ in found] or [np.zeros((0, 4))]).astype(np.float32)
        words = np.concatenate([d for _, d in found] or [np.zeros((0, 4), np.int64)])
        number = np.concatenate([np.arange(n) for n in counts] or [np.zeros(0, int)])
        columns = [pa.array(number, pa.int32()), *[pa.array(np.ascontiguousarray(places[:, k])) for k in range(4)], *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(4)]]
        rows = pa.StructArray.from_arrays(columns, names=["corner", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("image_id"), batch.column("asked"), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, rows)], ["image_id", "asked", "digest", "features"])


# -- meeting and agreeing --------------------------------------------------------------------------------------------


def _words(prefix: str = "") -> list[Column]:
    """The words of a descriptor, BITS / TABLES bits each, which are its keys."""
    return [F.col(f"{prefix}d{k}") for k in range(TABLES)]


def _keys(features: DataFrame, name: str, prefix: str) -> DataFrame:
    """A row per corner and table; the corner's columns are called after the first letters of theirs, behind ``prefix``."""
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.xxhash64(F.lit(k), word).alias("key")) for k, word in enumerate(_words())])
    corner = [F.col(c).alias(prefix + c[0]) for c in ("x", "y", "scale", "angle")]
    return features.select(
        F.col("class_id").alias(name), F.col("corner").alias(f"{name}_corner"), *corner,
        *[word.alias(f"{prefix}d{k}") for k, word in enumerate(_words())], F.explode(tables).alias("t")).select("*", "t.*").drop("t")


def matches(queries: DataFrame, features: DataFrame, far: int = FAR) -> DataFrame:
    """Corners of two classes that share a key and differ in at most ``far`` bits, each pair once, with both corners' columns."""
    mine = settle(_keys(queries, "query", "q"))
    theirs = _table_join(_keys(features, "other", ""), mine.select("key").distinct(), "key", "left_semi")
    met = lookup_join(theirs, mine.drop("table"), "key", salt_by=["other", "other_corner", "table"])
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_words(), _words("q"))), F.lit(0))
    before = F.lit(False)
    for k, (a, b) in enumerate(zip(_words(), _words("q"))):
        before = before | ((F.col("table") > k) & (a == b))
    return met.filter((F.col("query") != F.col("other")) & (apart <= far) & ~before)


def _table_join(rows: DataFrame, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a smaller table: broadcast if its counted size is small, else shuffled."""
    return rows.join(F.broadcast(table) if fits_broadcast(table) else table, on, how)


def _agree(least: int, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, matches in enumerate(batch.column("matches").to_pylist()):
                m = np.array([[r[c] for c in ("qx", "qy", "qs", "qa", "x", "y", "s", "a")] for r in matches], float)
                scale, turn = m[:, 6] / m[:, 2], m[:, 7] - m[:, 3]
                cos, sin = scale * np.cos(turn), scale * np.sin(turn)
                # the transform that each single match proposes, and where it takes the corners of all matches
                dx, dy = m[:, 0] - m[:, None, 0], m[:, 1] - m[:, None, 1]
                x = m[:, None, 4] + cos[:, None] * dx - sin[:, None] * dy
                y = m[:, None, 5] + sin[:, None] * dx + cos[:, None] * dy
                near = np.hypot(x - m[:, 4], y - m[:, 5]) <= slack * np.maximum(m[:, 2], m[:, 6])
                near &= np.abs(np.log2(scale) - np.log2(scale[:, None])) < 0.8
                near &= np.cos(turn - turn[:, None]) > 0.8
                # a corner counts once, however many it is like
                support = [len({(r["qx"], r["qy"]) for r, ok in zip(matches, line) if ok}) for line in near]
                best = int(np.argmax(support))
                if support[best] >= least:
                    on = near[best]
                    out.append((k, len(matches), support[best], float(np.median(scale[on])), float(np.arctan2(np.sin(turn[on]).mean(), np.cos(turn[on]).mean())),
                                float(np.median(m[on, 4] - cos[best] * m[on, 0] + sin[best] * m[on, 1])),
                                float(np.median(m[on, 5] - sin[best] * m[on, 0] - cos[best] * m[on, 1]))))
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("query").take(rows), batch.column("other").take(rows), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
                *[pa.array([o[c] for o in out], pa.float64()) for c in range(3, 7)],
            ], ["query", "other", "matches", "inliers", "scale", "turn", "shift_x", "shift_y"])

    return run


def find_copies(images: DataFrame, queries: Column, image: str = "image", id_col: str = "image_id", far: int = FAR, least: int = LEAST,
                slack: float = SLACK) -> DataFrame:
    """(role, image_id, class_id, query_id, matches, inliers, scale, turn, shift_x, shift_y).

    A row of role ``member`` per image names its class, the smallest id of the images with its bytes. A row of role ``copy``
    for every class of which an image fulfils the condition ``queries`` and every other class that holds a cropped or
    edited copy of it: image_id and class_id are the copy's class, query_id the query's, and the transform takes places of the
    query to places of the copy.

    Defined results: a very large image is described whole;
    a null, empty or undecodable image has no corners and no copies, and nulls are one class; images
    without an id are compared if their bytes have one elsewhere; repeated rows are members twice; an image too small for a
    patch has no corners; of a large one the strongest corners count, as many as of a small one; ties between corners go to the upper, then the left one; an empty table gives an empty table; other
    columns are not read.
    """
    slim = images.select(F.col(id_col).alias("image_id"), F.col(image).alias("image"), F.coalesce(queries, F.lit(False)).alias("asked"))
    id_type = slim.schema["image_id"].dataType.simpleString()
    bounded_batches(images.sparkSession)
    described = settle(slim.mapInArrow(_describe, f"image_id {id_type}, asked boolean, digest string, features {FEATURES}"))
    groups = settle(described.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("image_id").alias("class_id"), F.max("asked").alias("asked")))
    # the image whose id names its class stands for it; of repeated rows one does
    stand = _table_join(described.select("image_id", "digest", "features"), groups.select("digest", "class_id"), "digest").filter("image_id = class_id")
    if described.groupBy("image_id").count().filter("count > 1").limit(1).count():
        stand = stand.dropDuplicates(["class_id"])
    features = stand.select("class_id", F.inline("features"))
    asked = settle(_table_join(features, groups.filter("asked").select("class_id"), "class_id", "left_semi"))
    met = matches(asked, features, far)
    votes = met.groupBy("query", "other").agg(F.collect_list(F.struct("qx", "qy", "qs", "qa", "x", "y", "s", "a")).alias("matches"))
    kind = f"query {id_type}, other {id_type}, matches long, inliers long, scale double, turn double, shift_x double, shift_y double"
    agreed = votes.filter(F.size("matches") >= least).mapInArrow(_agree(least, slack), kind)
    links = agreed.select(
        F.lit("copy").alias("role"), F.col("other").alias("image_id"), F.col("other").alias("class_id"), F.col("query").alias("query_id"),
        "matches", "inliers", "scale", "turn", "shift_x", "shift_y")
    nothing = described.filter("digest IS NULL").agg(F.min("image_id")).first()[0]
    named = _table_join(described.select("image_id", "digest"), groups.select("digest", "class_id"), "digest", "left")
    named = named.withColumn("class_id", F.when(F.col("digest").isNull(), F.lit(nothing)).otherwise(F.col("class_id")))
    return named.select(F.lit("member").alias("role"), "image_id", "class_id").unionByName(links, allowMissingColumns=True)
