import base64
import glob
import gzip
import hashlib
import random

import pytest

from arborlake.llm import warc
from arborlake.llm.warc import read_warc, write_warc
from arborlake.session import scratch_path


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    same = "<p>" + "same " * 400
    rows = [(k, f"http://host{k % 3}/a b\n{k}", "".join(rng.choice("abcdefgh <>é\r\n") for _ in range(rng.choice([0, 1, 50, 4000])))) for k in range(60)]
    rows += [(100 + k, "http://same/", same) for k in range(30)] + [(200, None, None), (201, "u", ""), (50, "again", rows[50][2]), (None, "u", "no id"), (None, "u", same)]
    rows += [(300, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (301, "u", "x" * 3_000_000)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, sha1 string, size string").repartition(4).cache()


def want(rows, least=0):
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            body = r["html"] or ""
            first[body] = min(r["page_id"], first.get(body, r["page_id"]))
    out = []
    for r in rows:
        body = r["html"] or ""
        lead = first.get(body)
        many = sum((x["html"] or "") == body for x in rows) > 1
        again = many and lead is not None and r["page_id"] != lead and len(body.encode()) >= least
        name = "none" if r["page_id"] is None else r["page_id"]
        out.append((f"urn:page:{name}", "revisit" if again else "response", f"urn:page:{lead}" if again else None, len(body.encode()),
                    base64.b32encode(hashlib.sha1(body.encode()).digest()).decode(), None if again else body.encode()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least,ranges", [(0, 4 << 20), (1, 1000), (10_000, 37)])
def test_round_trip(spark, pages, least, ranges):
    folder = write_warc(pages, scratch_path(spark, "warc"), least=least)
    small = read_warc(spark, folder, range_bytes=ranges)
    assert got(small) == want(pages.collect(), least)
    assert small.select("path", "offset").distinct().count() == pages.count()


def test_files_are_plain_gzip(spark, pages):
    folder = write_warc(pages, scratch_path(spark, "warc"))
    names = glob.glob(folder.removeprefix("file:") + "/*.warc.gz")
    assert names and sum(gzip.open(n).read().count(b"WARC-Record-ID") for n in names) == pages.count()


def test_large_record(spark):
    body = "0123456789abcdef" * (5 << 18)
    pages = spark.createDataFrame([(1, "u", body), (2, "u", "small"), (3, "u", body)], "page_id long, url string, html string").coalesce(1)
    folder = write_warc(pages, scratch_path(spark, "warc"))
    assert got(read_warc(spark, folder, range_bytes=5000)) == want(pages.collect())


class Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at:self.at + n]


def test_a_stored_member_inside_a_payload_is_not_a_record(monkeypatch):
    inner = warc._member(warc.record("9", "u", b"inner", 5, "D", None))
    monkeypatch.setattr(warc, "LEVEL", 0)
    outer = warc._member(warc.record("1", "u", b"before" + inner + b"after", 11 + len(inner), "D", None))
    monkeypatch.setattr(warc, "LEVEL", 6)
    data = outer + warc._member(warc.record("2", None, b"next", 4, "D", None)) + b"\x1f\x8b\x08 cut short"
    assert inner in outer
    for step in (1, 7, 64, 1 << 20):
        ids = [r["headers"]["warc-record-id"] for a in range(0, len(data), step) for r in warc.records(warc.Source(Bytes(data), len(data)), a, min(a + step, len(data)))]
        assert ids == ["<urn:page:1>", "<urn:page:2>"]


@pytest.mark.parametrize("block", [3, 16, 1 << 20])
def test_small_blocks(monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    data = b"".join(warc._member(warc.record(str(k), "u", b"x" * k, k, "D", None)) for k in range(5))
    found = [r["headers"]["warc-record-id"] for a in range(0, len(data), 50) for r in warc.records(warc.Source(Bytes(data), len(data)), a, min(a + 50, len(data)))]
    assert found == [f"<urn:page:{k}>" for k in range(5)]


def test_damaged_payload_is_reported(spark, pages):
    folder = write_warc(pages.filter("page_id < 3"), scratch_path(spark, "warc"))
    bad = warc._member(warc.record("1", "u", b"text", 4, "A" * 32, None))
    with open(folder.removeprefix("file:") + "/part-bad.warc.gz", "wb") as file:
        file.write(bad)
    with pytest.raises(Exception, match="does not have its digest"):
        read_warc(spark, folder).count()


def test_empty(spark, pages):
    assert read_warc(spark, write_warc(pages.limit(0), scratch_path(spark, "warc"))).count() == 0
