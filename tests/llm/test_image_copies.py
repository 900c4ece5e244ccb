import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlake import session
from arborlake.llm.image_copies import FAR, LEAST, SLACK, _agree, decode, describe, find_copies
from arborlake.llm.media import EDITS, SIDE, edited, pgm, picture, vector_images, _waves


def png(pixels, kinds):
    """An 8-bit PNG whose row k is filtered by kinds[k % len(kinds)]."""
    h, w, deep = pixels.shape
    flat, lines, above = pixels.reshape(h, w * deep).astype(int), [], np.zeros(w * deep, int)
    for k in range(h):
        row, kind = flat[k], kinds[k % len(kinds)]
        left = np.concatenate([np.zeros(deep, int), row[:-deep]])
        corner = np.concatenate([np.zeros(deep, int), above[:-deep]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[deep], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_decoding():
    rng = np.random.RandomState(0)
    for deep in (1, 2, 3, 4):
        pixels = rng.randint(0, 256, (7, 5, deep)).astype(np.uint8)
        gray = pixels[:, :, 0].astype(float) if deep < 3 else pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])
        assert np.allclose(decode(png(pixels, [0, 1, 2, 3, 4])), gray, atol=1e-3)
    assert np.allclose(decode(pgm(gray)), np.rint(gray))
    for bad in (None, b"", b"GIF89a", b"P5\n9 9\n255\nshort", b"\x89PNG\r\n\x1a\nbroken"):
        assert decode(bad) is None


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.RandomState(3)
    return list(picture(rng.normal(size=(60, 64)), _waves(64)))


def test_descriptors_turn_with_the_image(drawn):
    for image in drawn[:3]:
        (p, d), (q, e) = describe(image), describe(np.rot90(image))
        near = sum(min(sum(((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() for a, b in zip(x, y)) for y in e) <= FAR for x in d)
        assert len(d) >= 20 and near >= 0.8 * len(d)


def test_edits_are_found_and_others_are_not(spark, drawn, no_broadcast, monkeypatch):
    rows = [(k * 10, pgm(image)) for k, image in enumerate(drawn)]
    edits = ["crop", "crop_bright", "noise", "quarter_turn", "contrast"]
    rows += [(k * 10 + 1, pgm(edited(drawn[k], edits[k % 5], k))) for k in range(50)]
    rows += [(k * 10 + 2, pgm(drawn[k])) for k in range(5)]
    rows += [(900, None), (901, b""), (902, b"no image"), (903, pgm(np.full((40, 40), 9.0))), (904, pgm(np.zeros((3, 3)))), (10, pgm(drawn[1])), (None, pgm(drawn[2]))]
    images = spark.createDataFrame([(*r, "x", 1, "d") for r in rows], "image_id long, image binary, class_id string, corner int, digest string").repartition(4)
    for share in (0.5, 0.0):  # no crowded key, and every key
        monkeypatch.setattr(session, "HEAVY_SHARE", share)
        out = find_copies(images, queries=F.col("image_id") % 10 == 0).collect()
        members = [r for r in out if r["role"] == "member"]
        assert len(members) == len(rows)
        assert {(r["image_id"], r["class_id"]) for r in members} >= {(2, 0), (12, 10), (42, 40), (41, 41)}
        links = {(r["query_id"], r["image_id"]) for r in out if r["role"] == "copy"}
        want = {(k * 10, k * 10 + 1) for k in range(50)}
        assert len(links & want) >= 0.95 * len(want)
        assert links - want == set()
    turned = next(r for r in out if r["query_id"] == 30 and r["role"] == "copy")
    assert abs(abs(turned["turn"]) - np.pi / 2) < 0.1 and abs(turned["scale"] - 1) < 0.1


def agreeing(a, b, keyed):
    """Most corners of two described images that agree on one transform, with or without the tables of keys."""
    (p, d), (q, e) = a, b
    bits = [np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1) for x in (d, e)]
    close = (bits[0][:, None] != bits[1]).sum(axis=2) <= FAR
    if keyed:
        close &= (d[:, None] == e).any(axis=2)
    names = ("qx", "qy", "qs", "qa"), ("x", "y", "s", "a")
    matches = [dict(zip(names[0], p[i])) | dict(zip(names[1], q[j])) for i, j in zip(*np.nonzero(close))]
    if len(matches) < LEAST:
        return False
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array([matches])], ["query", "other", "matches"])
    return next(iter(_agree(LEAST, SLACK)([batch]))).num_rows > 0


def test_recall_against_brute_force(drawn):
    """The tables keep at least nine in ten of the copies that comparing all descriptors finds."""
    plain = [describe(decode(pgm(i))) for i in drawn]
    copies = [describe(decode(pgm(edited(drawn[k], EDITS[k % len(EDITS)], k)))) for k in range(len(drawn))]
    pairs = [(k, j) for k in range(0, len(drawn), 2) for j in range(len(drawn)) if j == k or j % 7 == 0]
    brute = {(k, j) for k, j in pairs if agreeing(plain[k], copies[j], False)}
    found = {(k, j) for k, j in brute if agreeing(plain[k], copies[j], True)}
    assert brute == {(k, k) for k in range(0, len(drawn), 2)}
    assert len(found) >= 0.9 * len(brute)


def test_derived_images(spark):
    rows = spark.createDataFrame([(k, [float((k * 7 + j) % 5) for j in range(64)], "x") for k in range(12)] + [(20, None, "x"), (23, [1.0] * 64, "x")], "vec_id long, embedding array<float>, label string")
    images = {r["image_id"]: r for r in vector_images(rows).collect()}
    assert images[3]["edit"] and not images[0]["edit"] and images[20]["image"] is None and images[23]["edit"] is None
    assert decode(bytes(images[0]["image"])).shape == (SIDE, SIDE)


def test_empty(spark):
    assert find_copies(spark.createDataFrame([], "image_id long, image binary"), queries=F.lit(True)).count() == 0


def test_a_crowd_of_copies_of_one_picture(spark, drawn, monkeypatch):
    """A hundred noisy copies share keys; whether keys count as crowded changes neither links nor matches."""
    rows = [(0, pgm(drawn[0]))] + [(k + 1, pgm(edited(drawn[0], "noise", k))) for k in range(100)] + [(500 + k, pgm(image)) for k, image in enumerate(drawn[1:20])]
    images = spark.createDataFrame(rows, "image_id long, image binary").repartition(4)
    found = []
    for share in (1e9, 0.0):
        monkeypatch.setattr(session, "HEAVY_SHARE", share)
        monkeypatch.setattr(session, "fits_broadcast", lambda *a, **k: False)
        out = find_copies(images, queries=F.col("image_id") % 50 == 0).filter("role = 'copy'").collect()
        found.append(sorted((r["query_id"], r["image_id"], r["matches"], r["inliers"]) for r in out))
    assert found[0] == found[1]
    links = {(q, i) for q, i, _, _ in found[0]}
    assert links == {(q, i) for q in (0, 50, 100) for i in range(101) if i != q}
