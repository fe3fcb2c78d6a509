"""Legacy web archives (ARC) converted to WARC.

An ARC file starts with a version block whose URL is ``filedesc:``; its second line names the
version. Records follow, each a header line, the declared number of bytes, and a line end:

* version 1: ``URL IP-address Archive-date Content-type Archive-length``
* version 2: ``URL IP-address Archive-date Content-type Result-code Checksum Location Offset
  Filename Archive-length``

``records`` parses these lines and lengths. ``to_warc`` gives each record what WARC asks for: an
identifier made from the archive's name and the record's place, so that conversions agree; the
date as a W3C timestamp; the type, response for an HTTP record and resource for others; SHA-256
digests of block and payload. Of records with equal payloads of at least ``LEAST_SHARED`` bytes the
one with the smallest number is kept whole, the others become revisit records of its identifier.

Archives are written by Spark's text writer, so that any file system and retried tasks work: one
archive a row and file, closed by its bytes, the last record's two closing line ends being the
writer's separator. They are read back as whole files and parsed by the declared lengths alone.
Header lines are read from the right, so that blanks in a URL do no harm; heads of HTTP records may
end their lines in line feeds alone.

A NULL payload is an empty one, a NULL URL is ``urn:none``; blanks and control characters of a URL
are percent-encoded, and decoded after reading. Records of one number and payload: the first by
archive and place is the response. A truncated or malformed archive raises an error that names the
place. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.scratch import new_folder, written
from textguard.llm.words import slices

LEAST_SHARED = 100
#: Bytes of an ARC archive, and at which a WARC archive is closed; a larger record makes a larger one.
ARCHIVE_BYTES = 4 << 20
WARC_BYTES = 16 << 20
CLOSING = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Characters of a URL that stay as they are in a header line.
_SAFE = "!#$&'()*+,/:;=?@[]-._~"
_HEAD_END = re.compile(rb"\r?\n\r?\n")


@dataclass(frozen=True)
class ArcRecord:
    url: str
    date: str
    kind: str
    block: bytes
    offset: int


def arc_date(when: datetime) -> str:
    return when.strftime("%Y%m%d%H%M%S")


def warc_date(date: str) -> str:
    """A W3C timestamp of an ARC date, which may be cut after the day or the minute."""
    digits = (date + "0000000000")[:14] if date.isdigit() and len(date) >= 8 else "19700101000000"
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 textguard\n{FIELDS[version]}\n\n".encode()
    return arc_header(f"filedesc://{name}", "0.0.0.0", date, "text/plain", 200, version, 0, name, len(body)) + body


def arc_header(url: str, ip: str, date: str, kind: str, status: int, version: int, offset: int, name: str, length: int) -> bytes:
    middle = f"{status} - - {offset} {name} " if version == 2 else ""
    return f"{url} {ip} {date} {kind} {middle}{length}\n".encode()


def records(archive: bytes, name: str) -> Iterator[ArcRecord]:
    """The records of an ARC archive after its version block, by header lines and lengths."""
    at, fields = 0, None
    while at < len(archive):
        end = archive.find(b"\n", at)
        if end == at:  # a spare line end between records
            at += 1
            continue
        if end < 0:
            raise ValueError(f"{name}: header line not ended at byte {at}")
        parts = archive[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            length = int(parts[-1])
            version = int(archive[end + 1 : end + 1 + length].split(b" ", 1)[0])
            fields = len(FIELDS[version].split())
            if not parts[0].startswith("filedesc:"):
                raise ValueError(f"{name}: no version block")
        else:
            tail = parts[1 - fields :]  # from the right, as old crawlers left spaces in URLs
            if len(parts) < fields or not parts[-1].isdigit():
                raise ValueError(f"{name}: header line of {len(parts)} fields at byte {at}")
            length = int(parts[-1])
            if end + 1 + length > len(archive):
                raise ValueError(f"{name}: record at byte {at} is cut")
            yield ArcRecord(unquote(" ".join(parts[: 1 - fields])), tail[1], tail[2], archive[end + 1 : end + 1 + length], at)
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head, with its empty line, and payload of an HTTP response; lines may end in line feeds alone."""
    end = _HEAD_END.search(block) if block.startswith(b"HTTP/") else None
    return (block[: end.end()], block[end.end() :]) if end else (b"", block)


def head_field(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        key, _, value = line.partition(":")
        if key.lower() == name.lower():
            return value.strip()
    return None


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A record without its closing line ends."""
    lines = ["WARC/1.1", *(f"{key}: {value}" for key, value in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warc_records(archive: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(fields, block)`` of each record, by the declared lengths."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        first, *lines = archive[at : max(end, at)].decode().split("\r\n")
        if end < 0 or not first.startswith("WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start, length = end + 4, int(fields["Content-Length"])
        if archive[start + length : start + length + 4] != CLOSING.encode():
            raise ValueError(f"{name}: record at byte {at} is cut")
        yield fields, archive[start : start + length]
        at = start + length + 4


# --- the jobs ---


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """``(name, archive)``: the pages as ARC archives, versions 1 and 2 in turn.

    A page's number travels as a field of its HTTP head.
    """
    date = arc_date(datetime(2009, 8, 7, 6, 5, 4))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for part in slices(batches, "html", ARCHIVE_BYTES):
            version = 1 + (task + made) % 2
            name = f"part-{task:05d}-{made:05d}.arc"
            out = bytearray(version_block(name, version, date))
            for row in part.to_pylist():
                payload = (row["html"] or "").encode()
                number = "" if row["page_id"] is None else f"X-Record-Number: {row['page_id']}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{number}Content-Length: {len(payload)}\r\n\r\n"
                block = head.encode() + payload
                url = quote(row["url"] or "urn:none", safe=_SAFE)
                out += b"\n" + arc_header(url, "0.0.0.0", date, "text/html", 200, version, len(out) + 1, name, len(block)) + block
            out += b"\n"
            made += 1
            yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "archive": pa.array([bytes(out)], pa.binary())})

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(build, "name string, archive binary")


def parsed(archives: DataFrame) -> DataFrame:
    """A row for each record of ARC archives ``(name, archive)``, with what WARC needs."""

    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, archive in zip(batch.column("name").to_pylist(), batch.column("archive"), strict=True):
                rows = []
                for record in records(archive.as_buffer().to_pybytes(), name):
                    head, payload = split_http(record.block)
                    number = head_field(head, "X-Record-Number") if head else None
                    rows.append(
                        {
                            "id": record_id(name, record.offset), "place": f"{name}#{record.offset:012d}",
                            "number": int(number) if number else None, "url": record.url, "date": warc_date(record.date),
                            "http": bool(head), "kind": record.kind, "head": head, "payload": payload,
                            "size": len(payload), "digest": hashlib.sha256(payload).hexdigest(),
                        }
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    text, number, raw = pa.string(), pa.int64(), pa.binary()
    schema = pa.schema(
        [("id", text), ("place", text), ("number", number), ("url", text), ("date", text), ("http", pa.bool_()),
         ("kind", text), ("head", raw), ("payload", raw), ("size", number), ("digest", text)]
    )
    return archives.select("name", "archive").mapInArrow(
        convert,
        "id string, place string, number bigint, url string, date string, http boolean, kind string, "
        "head binary, payload binary, size bigint, digest string",
    )


def originals(found: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``(digest, least)``: of payloads that several records hold, the record to keep whole."""
    return (
        found.where(F.col("size") >= least).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("number").isNull().alias("unknown"), "number", "place", "id", "url", "date")).alias("least"))
        .where("n > 1").select("digest", "least")
    )


def to_warc(archives: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``record``: WARC records, without closing line ends, of ARC archives ``(name, archive)``."""
    found = parsed(archives)
    # who repeats whom is settled on narrow rows and comes back by the record's id: no key is hot for
    # the payloads, and the written sides let Spark split a digest that very many records share
    narrow = written(found.drop("head", "payload", "http", "kind"), "records")
    repeated = written(originals(narrow, least), "originals")
    joined = found.join(narrow.join(repeated, "digest").select("id", "least"), "id", "left")

    def synthesise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload"):
            out = []
            for row in part.to_pylist():
                original = row["least"]
                again = original is not None and original["id"] != row["id"]
                fields = {
                    "WARC-Type": "revisit" if again else "response" if row["http"] else "resource",
                    "WARC-Record-ID": row["id"],
                    "WARC-Date": row["date"],
                    "WARC-Target-URI": quote(row["url"], safe=_SAFE),
                    "WARC-Payload-Digest": f"sha256:{row['digest']}",
                }
                block = row["head"] if again else row["head"] + row["payload"]
                if again:
                    fields["WARC-Profile"] = REVISIT_PROFILE
                    fields["WARC-Refers-To"] = original["id"]
                    fields["WARC-Refers-To-Target-URI"] = quote(original["url"], safe=_SAFE)
                    fields["WARC-Refers-To-Date"] = original["date"]
                    if original["number"] is not None:
                        fields["X-Refers-To-Number"] = str(original["number"])
                fields["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
                fields["Content-Type"] = "application/http;msgtype=response" if row["http"] else row["kind"]
                out.append(warc_record(fields, block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return joined.select("id", "url", "date", "http", "kind", "head", "payload", "digest", "least").mapInArrow(synthesise, "record binary")


def write_archives(rows: DataFrame, folder: str) -> None:
    """The WARC records as gzipped archives in ``folder``, closed when they reach ``WARC_BYTES``.

    Each begins with a ``warcinfo`` record.
    """

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def archive(own: list[bytes]) -> pa.RecordBatch:
            fields = {
                "WARC-Type": "warcinfo", "WARC-Record-ID": record_id(f"part-{task:05d}-{made:05d}.warc", 0),
                "WARC-Date": warc_date(""), "Content-Type": "application/warc-fields",
            }
            whole = CLOSING.encode().join([warc_record(fields, b"software: textguard\r\nformat: WARC File Format 1.1\r\n"), *own])
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["archive"])

        own, size = [], 0
        for batch in batches:
            for record in batch.column("record"):
                own.append(record.as_py())
                size += len(own[-1])
                if size >= WARC_BYTES:
                    yield archive(own)
                    own, size, made = [], 0, made + 1
        if own:
            yield archive(own)

    # a string keeps the bytes of the binary as they are, and the text writer writes them so
    (
        rows.mapInArrow(bundle, "archive binary").select(F.col("archive").cast("string").alias("value"))
        .write.option("lineSep", CLOSING).option("compression", "gzip").option("maxRecordsPerFile", 1).mode("append").text(folder)
    )


def read_archives(spark, folder: str) -> DataFrame:
    """A row for each record of the archives in ``folder``, payloads checked by their digests."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for name, packed in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for fields, block in warc_records(gzip.decompress(packed.as_buffer()), name):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    again = fields["WARC-Type"] == "revisit"
                    if not again and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: {fields['WARC-Record-ID']} has another payload")
                    number, refers = head_field(head, "X-Record-Number"), fields.get("X-Refers-To-Number")
                    rows.append(
                        {
                            "page_id": int(number) if number else None,
                            # a revisit has its head alone, which declares the payload's length
                            "payload_bytes": int(head_field(head, "Content-Length") or 0) if again else len(payload),
                            "payload_digest": digest, "record_type": fields["WARC-Type"],
                            "refers_to": int(refers) if refers else None, "record_id": fields["WARC-Record-ID"],
                            "url": unquote(fields["WARC-Target-URI"]), "warc_date": fields["WARC-Date"],
                        }
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("warc_date", pa.string())]
    )
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", "content").mapInArrow(
        read,
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "record_id string, url string, warc_date string",
    )


def convert_pages(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Pages as ARC archives, converted to WARC, written to shared storage and read back."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(to_warc(pages_to_arc(pages), least), folder)
    return read_archives(pages.sparkSession, folder)
