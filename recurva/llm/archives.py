"""Legacy archives: ARC files of version 1 and 2 written, read by their declared lengths, and converted to WARC.

Archives are written by Spark's text sink, one row per file, so that any store Spark can write to will do and a lost
task is simply run again. Each task fills one file after the other: a description first, then records until the next one
would take it beyond `ARCHIVE_BYTES`. So a run of large pages makes more files and not larger ones, and only a record
that is larger by itself makes a larger file. Archives are read as whole files and walked in Arrow batches.

Conversion walks the archives twice. The first walk returns a line per record without its payload; equal payloads are
found among those lines. The second walk writes the records. Payloads are never grouped, and are moved between tasks
only if the list of revisits is too long to be sent to each task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurva.session import checkpointed, scratch_path

#: Bytes of records in a file before compression, at most, unless it holds a single one.
ARCHIVE_BYTES = 32_000_000
#: Bytes of records handed back to Spark in one batch.
BATCH_BYTES = 8_000_000

# The record line of each ARC version, as its description states it.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class ArcRecord(NamedTuple):
    offset: int
    url: str
    address: str
    date: str
    content_type: str
    block: bytes
    whole: bool


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _escaped(url: str) -> str:
    """A URL as one word: blanks and control characters as percent codes."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def arc_line(version: int, url: str, date: str, content_type: str, block: bytes, offset: int = 0, name: str = "-") -> bytes:
    """A record's line: version 1 has five fields, version 2 ten, of which the unknown ones are `-`."""
    if version == 1:
        fields = [url, "0.0.0.0", date, content_type, len(block)]
    else:
        fields = [url, "0.0.0.0", date, content_type, 200, "-", "-", offset, name, len(block)]
    return " ".join(map(str, fields)).encode()


def arc_description(version: int, name: str, date: str) -> bytes:
    """The first record of a file, without the line end that closes it: what the file is and how its lines are read."""
    block = f"{version} 0 recurva\n{ARC_FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{name}", date, "text/plain", block) + b"\n" + block


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive after its description, by the declared lengths.

    The description names the version, which says how many fields a line has; they are counted from the end, so a URL
    may hold blanks. A last record shorter than declared comes with what there is. A line that does not fit raises.
    """
    at, fields = 0, None
    while True:
        while data[at:at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        parts = line.rsplit(" ", (fields or 2) - 1)
        if not parts[-1].isdigit() or (fields and len(parts) != fields):
            raise ValueError(f"no record line at byte {at}: {line[:80]!r}")
        start, size = end + 1, int(parts[-1])
        block = data[start:start + size]
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("the archive does not begin with its description")
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown version {version}")
            fields = len(ARC_FIELDS[version].split())
        else:
            yield ArcRecord(at, parts[0], parts[1], parts[2], parts[3], block, len(block) == size)
        at = start + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Headers with the blank line that ends them, and payload; a block that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[:end + 4], block[end + 4:]) if end >= 0 else (block, b"")


def warc_date(date: str) -> str:
    """An ISO time of up to 14 digits, with the first possible value where digits are missing."""
    digits = re.sub("[^0-9]", "", date)[:14]
    full = digits + "00000101000000"[len(digits):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    """An identifier that follows from the place of the record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_record(kind: str, own_id: str, date: str, block: bytes, content_type: str, *more: tuple[str, str | None]) -> bytes:
    """A record without the two line ends that close it."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), *more,
             ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = [f"{name}: {value}" for name, value in named if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start, size = end + 4, int(fields["content-length"])
        yield fields, data[start:start + size]
        at = start + size + 4


def _http_field(headers: bytes, name: str) -> str | None:
    for line in headers.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES; the size of a row is that of its last value, if it is bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _filled(records: Iterator[tuple[int, Callable[[int], bytes], Callable[[int], bytes]]], separator: bytes, limit: int) -> Iterator[tuple[bytes]]:
    """Whole files from records: each a size, and what it adds to a file of a given number, first as its opening, then as a record."""
    held, size, number = [], 0, 0
    for length, opening, record in records:
        if held and size + length > limit:
            yield (separator.join(held),)
            held, size, number = [], 0, number + 1
        if not held:
            held.append(opening(number))
        held.append(record(number))
        size += length
    if held:
        yield (separator.join(held),)


def _write(files: DataFrame, path: str, separator: bytes) -> None:
    files.select(F.col("value").cast("string")).write.option("lineSep", separator.decode()).option(
        "maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def write_arc(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> None:
    """`df` as ARC files below `path`, files of both versions in turn: a record per row, with the page in UTF-8 as the body of
    an HTTP response that names the page's id. NULL pages are empty; a NULL URL is `about:blank`; a NULL id is left out."""
    schema, limit = pa.schema([("value", pa.binary())]), ARCHIVE_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for page, address, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    payload = (text or "").encode()
                    named = "" if page is None else f"X-Page-Id: {page}\r\n"
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                    url_word = _escaped(address or "about:blank")
                    yield (len(block), lambda n: arc_description(1 + n % 2, f"part-{n}.arc", date),
                           lambda n, u=url_word, b=block: arc_line(1 + n % 2, u, date, "text/html", b) + b"\n" + b)

        yield from _batches(_filled(records(), b"\n", limit), schema)

    _write(df.select(F.col(page_id).cast("long"), F.col(url), F.col(html)).mapInArrow(work, "value binary"), path, b"\n")


def _arc_index(spark: SparkSession, path: str) -> DataFrame:
    """A line per record, without its payload."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                        ("date", pa.string()), ("digest", pa.string()), ("size", pa.int64())])

    def work(batches):
        def rows():
            for batch in batches:
                for archive, content in zip(*(batch.column(i).to_pylist() for i in range(2))):
                    for r in parse_arc(gzip.decompress(content)):
                        headers, payload = split_http(r.block)
                        page = _http_field(headers, "x-page-id")
                        yield archive, r.offset, page and int(page), r.url, warc_date(r.date), sha1_base32(payload), len(payload)
        yield from _batches(rows(), schema)

    return _files(spark, path).mapInArrow(
        work, "archive string, offset long, page_id long, url string, date string, digest string, size long")


def convert_to_warc(spark: SparkSession, arc_path: str, path: str, min_bytes: int = 0) -> None:
    """The ARC files below `arc_path` as WARC files below `path`.

    HTTP responses become `response` records, others `resource`; times, identifiers and digests follow from the ARC
    record. Of records with equal payloads of at least `min_bytes` bytes the one with the smallest page id stays, ids
    before none and ties by place; the others become `revisit` records, which keep the HTTP headers, refer to it and
    leave the payload out. A truncated last record says so.
    """
    index = checkpointed(_arc_index(spark, arc_path))
    limit = ARCHIVE_BYTES
    order = F.struct(F.col("page_id").isNull(), "page_id", "archive", "offset")
    whole = index.where(F.col("size") >= min_bytes)
    firsts = checkpointed(whole.groupBy("digest", "size").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("archive", "offset", "url", "date"), order).alias("first")).where("n > 1"))
    revisits = checkpointed(whole.select("archive", "offset", "digest", "size").join(firsts, ["digest", "size"]).where(
        (F.col("archive") != F.col("first.archive")) | (F.col("offset") != F.col("first.offset"))).select("archive", "offset", "first"))
    fields = ["archive", "offset", "url", "address", "date", "content_type", "whole", "block"]
    schema = pa.schema(list(zip(fields, [pa.string(), pa.int64(), *[pa.string()] * 4, pa.bool_(), pa.binary()])))

    def walk(batches):
        def rows():
            for batch in batches:
                for archive, content in zip(*(batch.column(i).to_pylist() for i in range(2))):
                    for r in parse_arc(gzip.decompress(content)):
                        yield archive, r.offset, r.url, r.address, warc_date(r.date), r.content_type, r.whole, r.block
        yield from _batches(rows(), schema)

    def write(batches):
        def about(r: dict) -> bytes:
            text = b"software: recurva\r\nformat: WARC File Format 1.1\r\n"
            return warc_record("warcinfo", record_id(r["archive"], -1 - r["offset"]), r["date"], text, "application/warc-fields")

        def records():
            for batch in batches:
                for r in batch.to_pylist():
                    headers, payload = split_http(r["block"])
                    digest, first = f"sha1:{sha1_base32(payload)}", r["first"]
                    known = [("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["address"]), ("WARC-Payload-Digest", digest),
                             ("WARC-Truncated", None if r["whole"] else "unspecified")]
                    kind, block, content_type = "response", r["block"], "application/http; msgtype=response"
                    if first is not None:
                        kind, block = "revisit", headers
                        known += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first["archive"], first["offset"])),
                                  ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"])]
                    elif not headers:
                        kind, content_type = "resource", r["content_type"]
                    record = warc_record(kind, record_id(r["archive"], r["offset"]), r["date"], block, content_type, *known)
                    yield len(record), lambda _, r=r: about(r), lambda _, record=record: record

        yield from _batches(_filled(records(), b"\r\n\r\n", limit), pa.schema([("value", pa.binary())]))

    found = _files(spark, arc_path).mapInArrow(
        walk, "archive string, offset long, url string, address string, date string, content_type string, whole boolean, block binary")
    _write(found.join(revisits, ["archive", "offset"], "left").mapInArrow(write, "value binary"), path, b"\r\n\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A line per response, resource or revisit record below `path`, without its payload.

    `page_id, record_id, record_type, url, date, payload_bytes, payload_digest, refers_to`; digests are bare, sizes and
    `refers_to`, a page id, of revisits are those of the record they refer to.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
                        ("date", pa.string()), ("payload_digest", pa.string()), ("refers", pa.string()), ("bytes", pa.int64())])

    def work(batches):
        def rows():
            for batch in batches:
                for content in batch.column(1).to_pylist():
                    for fields, block in parse_warc(gzip.decompress(content)):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        headers, payload = split_http(block)
                        page = _http_field(headers, "x-page-id")
                        yield (page and int(page), fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields["warc-date"],
                               fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("warc-refers-to"), len(payload))
        yield from _batches(rows(), schema)

    lines = checkpointed(_files(spark, path).mapInArrow(work, "page_id long, record_id string, record_type string, url string, "
                                                        "date string, payload_digest string, refers string, bytes long"))
    kept = lines.where("refers IS NULL").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("first_bytes"))
    revisits = lines.where("refers IS NOT NULL").join(kept, "refers", "left")
    own = lines.where("refers IS NULL").select(*lines.columns, F.lit(None).cast("long").alias("refers_to"), F.col("bytes").alias("first_bytes"))
    return own.unionByName(revisits).select("page_id", "record_id", "record_type", "url", "date", F.col("first_bytes").alias("payload_bytes"),
                                            "payload_digest", "refers_to")


def archive_pages(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """`df` written as ARC, converted to WARC and read back, one line per row, as `read_warc` gives them.

    Repeated rows are records of their own, the later ones revisits. An empty table gives an empty table; further columns are
    not written. The archives stay in the folder for checkpoints.
    """
    spark = df.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(df, arc, page_id, url, html)
    convert_to_warc(spark, arc, warc, min_bytes)
    return read_warc(spark, warc)
