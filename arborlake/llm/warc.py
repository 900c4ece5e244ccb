"""WARC archives: one gzip member per record, written through Spark and read back by byte ranges.

Writing goes through Spark's text writer, so files are committed task by task wherever Spark can write. A record's gzip
member is one line; the line separator is the zero byte that ends the member anyway (the highest byte of its length), so
the files are plain concatenations of members. A record of 16 MiB or more does not end in a zero byte and is followed by
an empty member that does.

Reading cuts every file into byte ranges, many to a file. A task looks in its range for the magic bytes of gzip and decodes what
follows; a candidate is a record if it begins with a WARC version, its block has the length the header names, and the
file ends or another member begins where it ends. A record belongs to the range it starts in, however far it reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fits_broadcast, settle
from .common import bounded_batches, slices

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
RANGE_BYTES = 4 << 20
SLICE_BYTES = 4 << 20
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A date has to stand in every record; a fixed one keeps equal input equal on disk.
DATE = "2000-01-01T00:00:00Z"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), value)


def record(name: str, url: str | None, payload: bytes | None, size: int, digest: str, refers: str | None) -> bytes:
    """A response with its payload, or, with ``refers``, a revisit of that response without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if refers is not None else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = _member(b"")
    for batch in batches:
        for part in slices(batch, pc.binary_length(batch.column("payload")), SLICE_BYTES):
            lines = []
            for row in part.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                line = _member(record(row["name"], row["url"], row["payload"], row["size"], digest, row["refers"]))
                if line[-1]:
                    line += empty
                lines.append(line[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])


def write_warc(pages: DataFrame, folder: str, html: str = "html", url: str = "url", id_col: str = "page_id", least: int = 0) -> str:
    """Write a record per row of ``pages`` into ``folder`` as ``*.warc.gz`` and return the folder.

    The payload is the text in UTF-8. Of rows with equal payloads of at least ``least`` bytes the one with the smallest id
    is a response and the others are revisits of it; shorter payloads are all responses.

    Defined results: a very long text is one record, read in blocks;
    a null text is an empty payload; a null address leaves its header out; a row without an id is called
    ``none``, and revisits the group's smallest id if there is one; rows that repeat both the id and the payload of a
    response are responses too; an empty table writes an archive without records; other columns are not read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("name"), F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    groups = rows.groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    groups = settle(groups.select("sha1", "first"))
    joined = rows.join(F.broadcast(groups) if fits_broadcast(groups) else groups, "sha1", "left")
    again = F.col("first").isNotNull() & (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("first"))
    ready = joined.select(
        F.coalesce("name", F.lit("none")).alias("name"), "url", "sha1", "size",
        F.when(again, F.col("first").cast("string")).alias("refers"), F.when(~again, F.col("payload")).alias("payload"))
    lines = ready.mapInArrow(_build, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("part-"):
            store.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(at, re.sub(r"(\.txt)?$", ".warc.gz", name, count=1)))
    return folder


# -- reading ---------------------------------------------------------------------------------------------------------


class Source:
    """A file read in blocks around a moving place."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.block = file, size, 0, b""

    def read(self, at: int, n: int = BLOCK) -> bytes:
        """Bytes from ``at`` on: at least one unless the file ends there."""
        if not self.at <= at < self.at + len(self.block):
            self.file.seek(at)
            self.at, self.block = at, self.file.read(max(n, BLOCK))
        return self.block[at - self.at:]

    def find(self, at: int, end: int) -> int:
        """The first place of the magic in [at, end), or -1."""
        while at < end:
            data = self.read(at)
            if len(data) < len(MAGIC):  # the magic may cross the blocks
                self.block = b""
                data = self.read(at)
                if len(data) < len(MAGIC):
                    return -1
            found = data.find(MAGIC)
            if found >= 0:
                return at + found if at + found < end else -1
            at += len(data) - len(MAGIC) + 1
        return -1


def decode(source: Source, at: int) -> tuple[bytes, int] | None:
    """The member at a place and where it ends; None if it isn't a WARC record."""
    unpacker, parts, place, started = zlib.decompressobj(31), [], at, False
    try:
        while not unpacker.eof:
            data = source.read(place)
            if not data:
                return None
            parts.append(unpacker.decompress(data))
            place += len(data)
            if not started and parts[0]:
                if not parts[0].startswith(b"WARC/"[: len(parts[0])]):
                    return None
                started = len(parts[0]) >= 5
                parts = parts if started else [b"".join(parts)]
    except zlib.error:
        return None
    whole, end = b"".join(parts), place - len(unpacker.unused_data)
    if not whole.startswith(b"WARC/"):
        return None
    after = source.read(end)[: len(MAGIC)]
    if after and not MAGIC.startswith(after):
        return None
    return whole, end


def parse(whole: bytes) -> dict | None:
    """Headers and block of a record; None if the block isn't as long as its header says."""
    head, gap, rest = whole.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError):
        return None
    if not gap or len(rest) < size or rest[size:] not in (b"\r\n\r\n", b""):
        return None
    return {"headers": headers, "block": rest[:size]}


def records(source: Source, start: int, end: int) -> Iterator[dict]:
    """The records that start in [start, end)."""
    at = start
    while (at := source.find(at, end)) >= 0:
        found = decode(source, at)
        parsed = parse(found[0]) if found else None
        if parsed:
            yield parsed | {"offset": at}
            at = found[1]
        else:
            at += 1


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(inner)


RECORD = ("path string, offset long, record_id string, record_type string, target_uri string, refers_to string, "
          "payload binary, payload_bytes long, payload_digest string")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])
    for batch in batches:
        for row in batch.to_pylist():
            with _open(row["path"]) as file:
                rows, held = [], 0
                for found in records(Source(file, row["length"]), row["start"], min(row["start"] + row["size"], row["length"])):
                    headers = found["headers"]
                    http, _, payload = found["block"].partition(b"\r\n\r\n")
                    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    revisit = headers.get("warc-type") == "revisit"
                    if not revisit and digest and base32_sha1(payload) != digest:
                        raise ValueError(f"{row['path']}: the payload at {found['offset']} does not have its digest")
                    rows.append(dict(zip(names, (
                        row["path"], found["offset"], headers.get("warc-record-id", "").strip("<>"), headers.get("warc-type"), headers.get("warc-target-uri"),
                        headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
                        None if revisit else payload, int(said[1]) if revisit and said else len(payload), digest))))
                    held += len(payload)
                    if held >= SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the archives in ``folder``; payloads of revisits are null, their size and digest are kept.

    The executors open the files with Arrow's file systems (local and shared folders, HDFS, the object stores it knows).
    A response whose payload does not have its digest raises an error. Empty files have no records.
    """
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.withColumn("size", F.lit(range_bytes).cast("long")).repartition(n, "path", "start").mapInArrow(_scan, RECORD)
